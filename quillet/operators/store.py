"""Owner-side tables: lookups, upserts, joins, cascades, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.scalar import as_date, filled, whole_text


def lookup(table: DataFrame, **key) -> DataFrame:
    """By key equality, which reaches the scan as a pushed filter."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def newest_first(collages: DataFrame) -> DataFrame:
    """H1."""
    return collages.orderBy(F.desc("updated_at"), "id")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """B1: new rows replace old ones of their key. Of new rows with one key the last wins: by ``seq`` if there is one, then
    by the row's text, so that reruns agree; the rest are dropped on the map side.

    Old rows without a new one keep their place by an anti-join: only keys of the new side are compared.
    """
    order = [F.col("seq")] if "seq" in new.columns else []
    row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    last = new.groupBy(*keys).agg(F.max_by(row, F.struct(*order, whole_text(row))).alias("row"))
    last = last.select(*[F.col(f"row.`{c}`") for c in new.columns if c != "seq"])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def put_placements(collages: DataFrame, placements: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """B2: the collages, touched where they get a placement, and the placements with the new ones (collage_id, ticket_id,
    ..., seq) in place of old ones."""
    hit = new.select(F.col("collage_id").alias("id"), F.lit(True).alias("hit")).distinct()
    touched = collages.join(hit, "id", "left").withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at"))).select(*collages.columns)
    return touched, upsert(placements, new, ["collage_id", "ticket_id"])


def plain_placements(placements: DataFrame) -> DataFrame:
    """As they are shared, without the collage's id."""
    return placements.drop("collage_id")


def aspects(placements: DataFrame, tickets: DataFrame, default: float = 0.4) -> DataFrame:
    """Placements with the aspect of their ticket (id, aspect), ``default`` if it is not known."""
    known = tickets.select(F.col("id").alias("ticket_id"), "aspect")
    return placements.join(known, "ticket_id", "left").withColumn("aspect", F.coalesce("aspect", F.lit(default)))


def latest_versions(images: DataFrame) -> DataFrame:
    """The greatest version of each (ticket_id, kind)."""
    return images.groupBy("ticket_id", "kind").agg(F.max("version").alias("version"))


def pending(names: DataFrame, ledger: DataFrame) -> DataFrame:
    """Migrations that the ledger does not have, in order of their names."""
    return names.join(ledger.select("name"), "name", "left_anti").orderBy("name")


def cards(tickets: DataFrame) -> DataFrame:
    """Board cards: aspect and which image to show."""
    return tickets.select("id", (F.col("height") / F.col("width")).alias("aspect"), F.when(F.col("blur_off"), "cutout").otherwise("blurred").alias("kind"))


def public_ticket(fields: Column, note: Column, image: Column, photo: Column, id_: Column) -> Column:
    """What a share may say of a ticket; the note ends at 600 characters."""
    return F.struct(id_.alias("id"), fields.alias("fields"), F.substring(F.coalesce(note, F.lit("")), 1, 600).alias("note"), image.alias("image"), photo.alias("photo"))


def public_title(title: Column, default: str = "My collage") -> Column:
    """120 characters, or the default."""
    return F.substring(F.coalesce(filled(F.trim(title)), F.lit(default)), 1, 120)


def view_cards(token: Column, tickets: Column) -> Column:
    """C4: source and aspect of each shared ticket."""
    return F.transform(tickets, lambda t: F.struct(t["id"].alias("id"), F.concat(F.lit("/api/shares/"), token, F.lit("/assets/"), t["image"]["hash"]).alias("src"), (t["image"]["h"] / t["image"]["w"]).alias("aspect")))


def bump(version: Column, changed: Column) -> Column:
    """C7."""
    return version + changed.cast("int")


def recent_trip(dates: Column, as_of) -> Column:
    """Aggregate: any date in the 14 days up to as_of, or the day after."""
    day = as_date(as_of)
    return F.coalesce(F.bool_or((dates > F.date_sub(day, 14)) & (dates <= F.date_add(day, 1))), F.lit(False))


def placed_tickets(placements: DataFrame, tickets: DataFrame) -> DataFrame:
    """Placements with their tickets; dangling ones drop out."""
    return placements.join(tickets.withColumnRenamed("id", "ticket_id"), "ticket_id")


def collage_contents(collages: DataFrame, placements: DataFrame, tickets: DataFrame) -> DataFrame:
    """Every collage with its ticket ids in layer order; empty ones with an empty list."""
    inside = placements.join(tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    lists = inside.groupBy("collage_id").agg(F.array_sort(F.collect_list(F.struct("z", "ticket_id"))).alias("items"))
    return collages.join(lists.withColumnRenamed("collage_id", "id"), "id", "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def publishable(placements: DataFrame, tickets: DataFrame, images: DataFrame) -> DataFrame:
    """Placements whose ticket has a blurred image, with the photo's bytes if the ticket has one."""
    of = lambda kind, name: images.where(F.col("kind") == kind).select("ticket_id", F.col("bytes").alias(name))
    photos = of("photo", "photo").join(tickets.where("has_photo").select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    return placed_tickets(placements, tickets).join(of("blurred", "image"), "ticket_id").join(photos, "ticket_id", "left")


def remove_collage(collages: DataFrame, placements: DataFrame, tickets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the collages in ``gone`` (id), their placements, and tickets that were on no other collage."""
    ids = gone.select("id")
    left = placements.join(ids.withColumnRenamed("id", "collage_id"), "collage_id", "left_anti")
    was = placements.join(ids.withColumnRenamed("id", "collage_id"), "collage_id", "left_semi").select(F.col("ticket_id").alias("id"))
    orphans = was.join(left.select(F.col("ticket_id").alias("id")), "id", "left_anti").distinct()
    return collages.join(ids, "id", "left_anti"), left, tickets.join(orphans, "id", "left_anti")


def collages_of(placements: DataFrame, collages: DataFrame, ticket_id: str) -> DataFrame:
    """M:N from the other side."""
    on = placements.where(F.col("ticket_id") == ticket_id).select(F.col("collage_id").alias("id"))
    return collages.join(on, "id", "left_semi")
