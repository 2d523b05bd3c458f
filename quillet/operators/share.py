"""Publishing: manifests, assets, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet import vocab
from quillet.functions.scalar import let, utf16_length, whole_text
from quillet.schemas import MANIFEST

# Longest texts of a shared ticket.
LONGEST = {"title": 120, "origin": 120, "destination": 120, "carrier": 120, "seat": 60}


def read_manifest(text: Column) -> Column:
    """Null for what is no JSON; ``asked`` says of each ticket whether it names a photo, be it null."""
    named = F.transform(F.from_json(text, "struct<tickets:array<map<string,string>>>")["tickets"], lambda t: F.map_contains_key(t, "photo"))
    return let(F.from_json(text, MANIFEST), lambda m: F.when(m.isNotNull(), F.struct(m["tickets"].alias("tickets"), m["placements"].alias("placements"), named.alias("asked"))))


def _asset_ok(a: Column) -> Column:
    return a["hash"].rlike(vocab.HASH_SHAPE) & a["w"].between(1, 4000) & a["h"].between(1, 4000)


def manifest_faults(title: Column, m: Column) -> Column:
    """Array of what is wrong, empty if nothing; the first three are what a caller is told (H9)."""
    return let(m, lambda m: _faults(title, m))


def _faults(title: Column, m: Column) -> Column:
    true = lambda c: F.coalesce(c, F.lit(False))
    every = lambda field, ok: F.forall(m[field], lambda x: true(ok(x)))
    checks = {
        "title": utf16_length(title).between(1, 120),
        "tickets": F.size(m["tickets"]) <= vocab.MOST_ITEMS,
        "placements": F.size(m["placements"]) <= vocab.MOST_ITEMS,
        "ticket id": every("tickets", lambda t: t["id"].rlike(vocab.ID_SHAPE)),
        "type": every("tickets", lambda t: t["fields"]["type"].isin(*vocab.KINDS)),
        "date": every("tickets", lambda t: (t["fields"]["date"] == "") | t["fields"]["date"].rlike(r"^\d{4}-\d{2}-\d{2}\z")),
        "note": every("tickets", lambda t: utf16_length(t["note"]) <= 600),
        "image": every("tickets", lambda t: _asset_ok(t["image"])),
        "photo": every("tickets", lambda t: t["photo"].isNull() | _asset_ok(t["photo"])) & F.forall(m["asked"], lambda x: true(x)),
        "placement id": every("placements", lambda p: p["ticketId"].rlike(vocab.ID_SHAPE)),
        "x": every("placements", lambda p: p["x"].between(-500, 1500)),
        "y": every("placements", lambda p: p["y"].between(-500, 50000)),
        "rotation": every("placements", lambda p: p["rotation"].between(-360, 360)),
        "scale": every("placements", lambda p: p["scale"].between(0.1, 5)),
        "z": every("placements", lambda p: p["z"].between(0, 100000)),
    }
    for name, most in LONGEST.items():
        checks[f"field {name}"] = every("tickets", _short(name, most))
    said = [F.when(~true(ok), name) for name, ok in checks.items()]
    return F.when(m.isNull(), F.array(F.lit("manifest"))).otherwise(F.filter(F.array(*said), lambda x: x.isNotNull()))


def _short(name: str, most: int):
    return lambda t: utf16_length(t["fields"][name]) <= most


def is_token(token: Column) -> Column:
    """D2."""
    return token.rlike(vocab.TOKEN_SHAPE)


def owner_matches(secret: Column, owner_hash: Column) -> Column:
    """D3."""
    return F.coalesce(utf16_length(secret).between(20, 100) & (F.sha2(secret.cast("binary"), 256) == owner_hash), F.lit(False))


def share_status(ready: Column, secret: Column, admitted: Column, faults: Column) -> Column:
    """Outcome of publishing, in the order of the checks."""
    return F.when(~ready, 503).when(secret.isNull() | ~utf16_length(secret).between(20, 100), 401).when(~admitted, 429).when(F.size(faults) > 0, 400).otherwise(200)


def asset_status(known: Column, owner: Column, size: Column, hash_ok: Column, referenced: Column) -> Column:
    """Outcome of an upload: cheap checks first."""
    return F.when(~known, 404).when(~owner, 403).when(size > vocab.MOST_BYTES, 413).when(~(hash_ok & referenced), 400).otherwise(200)


def referenced(shares: DataFrame) -> DataFrame:
    """token, hash, ord: distinct hashes of images and photos, in manifest order (shares: token, m)."""
    hashes = F.transform(F.col("m.tickets"), lambda t: F.filter(F.array(t["image"]["hash"], t["photo"]["hash"]), lambda h: h.isNotNull()))
    return shares.select("token", F.posexplode(F.array_distinct(F.flatten(hashes))).alias("ord", "hash"))


def missing_assets(shares: DataFrame, assets: DataFrame) -> DataFrame:
    """Referenced hashes that are not stored, in manifest order."""
    return referenced(shares).join(assets.select("token", "hash"), ["token", "hash"], "left_anti")


def drop_unreferenced(shares: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets of these shares that the manifest no longer names go, all of them if it names none; others stay."""
    keep = assets.join(referenced(shares).select("token", "hash"), ["token", "hash"], "left_semi")
    other = assets.join(shares.select("token"), "token", "left_anti")
    return keep.unionByName(other)


def ingest_assets(uploads: DataFrame, shares: DataFrame, assets: DataFrame) -> DataFrame:
    """Uploads (token, hash, bytes, ord) that fit their hash, are referenced and small enough, and are not stored
    yet; one of each."""
    ok = uploads.where((F.octet_length("bytes") <= vocab.MOST_BYTES) & (F.sha2("bytes", 256) == F.col("hash")))
    ok = ok.join(referenced(shares).select("token", "hash"), ["token", "hash"], "left_semi").join(assets.select("token", "hash"), ["token", "hash"], "left_anti")
    first = Window.partitionBy("token", "hash").orderBy("ord")
    return ok.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def insert_new(rows: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """On conflict do nothing: one row of each key that is not stored, the first by ``order`` and then by its text,
    nulls included; the others are dropped on the map side."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    first = rows.groupBy(*keys).agg(F.min_by(row, F.struct(F.col(order), whole_text(row))).alias("row"))
    return first.select(*[F.col(f"row.`{c}`") for c in rows.columns]).join(stored.select(*keys), keys, "left_anti")


def publish(shares: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The shares after the requests, and what each request came to.

    ``requests``: id, token (null for a first one), owner_hash, title, manifest, seq, fresh (a token not in use). A request
    for a known token of its owner replaces title and manifest, the last by ``seq``; one for a token that is gone, or that
    has none, adds a share under its fresh token; one for another owner's token is refused (403) and changes nothing.
    """
    held = shares.select("token", F.col("owner_hash").alias("holder"), F.col("created_at").alias("born"))
    met = requests.join(held, "token", "left")
    known = F.col("holder").isNotNull()
    first = met.where(~known).groupBy("fresh").agg(F.min_by("owner_hash", F.struct("seq", "id")).alias("taker"))
    taken = first.join(held.select(F.col("token").alias("fresh"), F.lit(True).alias("used_before")), "fresh", "left")
    met = met.join(taken, "fresh", "left")
    clash = F.coalesce("used_before", F.lit(False)) | ~F.col("taker").eqNullSafe(F.col("owner_hash"))
    status = F.when(known & ~F.col("holder").eqNullSafe(F.col("owner_hash")), 403).when(known, 200).when(clash, 403).otherwise(201)
    outcome = met.select("id", status.alias("status"), F.when(known, F.col("token")).otherwise(F.col("fresh")).alias("used"), "owner_hash", "title", "manifest", "seq", "born")
    done = outcome.where("status <> 403")
    last = done.groupBy(F.col("used").alias("token")).agg(F.max_by(F.struct("owner_hash", "title", "manifest", "born"), F.struct("seq", "id")).alias("r"))
    new = last.select("token", "r.owner_hash", "r.title", "r.manifest", F.coalesce("r.born", now).alias("created_at"), now.alias("updated_at"))
    return shares.join(new.select("token"), "token", "left_anti").unionByName(new.select(*shares.columns)), outcome.select("id", "status", F.when(F.col("status") != 403, F.col("used")).alias("token"))


def add_event(events: DataFrame, key: str, now: Column) -> DataFrame:
    """The events with one more row."""
    one = events.sparkSession.range(1).select(F.lit(key).alias("key"), now.alias("at"))
    return events.unionByName(one.select(*events.columns))


def delete_shares(shares: DataFrame, assets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares and, by cascade, their assets; unknown tokens change nothing."""
    return shares.join(gone.select("token"), "token", "left_anti"), assets.join(gone.select("token"), "token", "left_anti")


def key_faults(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a primary key would refuse: repeated or null keys, with their counts."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def reference_faults(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that a foreign key would refuse."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
