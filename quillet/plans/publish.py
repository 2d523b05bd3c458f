"""Queries of the owner's tables and of publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import metered, scan, share, store
from quillet.plans.base import query, table


def _owned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as placements on their customer's collage, and as tickets: those of some price have one."""
    o = table(spark, sf_dir, "orders")
    placements = o.select(F.col("o_custkey").alias("collage_id"), F.col("o_orderkey").alias("ticket_id"), (F.col("o_orderkey") % 50).cast("int").alias("z"))
    tickets = o.where("o_totalprice > 100000").select(
        F.col("o_orderkey").alias("id"), F.lit(200).alias("width"), (F.col("o_orderkey") % 90 + 20).cast("int").alias("height"), (F.col("o_orderkey") % 3 == 0).alias("blur_off"), (F.col("o_orderkey") % 4 == 0).alias("has_photo")
    )
    return placements, tickets


@query("e1_placed", "SELECT o_custkey AS collage_id, o_orderkey AS ticket_id, (o_orderkey % 50)::INT AS z, (o_orderkey % 3 = 0) AS blur_off FROM orders WHERE o_totalprice > 100000")
def e1_placed(spark, sf_dir):
    return store.placed_tickets(*_owned(spark, sf_dir)).select("collage_id", "ticket_id", "z", "blur_off")


@query("e15_aspects", "SELECT o_orderkey AS ticket_id, CASE WHEN o_totalprice > 100000 THEN (o_orderkey % 90 + 20) / 200.0 ELSE 0.4 END::DOUBLE AS aspect FROM orders")
def e15_aspects(spark, sf_dir):
    placements, tickets = _owned(spark, sf_dir)
    known = store.cards(tickets).select("id", "aspect")
    return store.aspects(store.plain_placements(placements), known).select("ticket_id", "aspect")


@query(
    "c2_public",
    """SELECT o_orderkey AS id, (o_orderkey % 90 + 20) / 200.0::DOUBLE AS aspect, CASE WHEN o_orderkey % 3 = 0 THEN 'cutout' ELSE 'blurred' END AS kind, '/api/shares/tok/assets/' || md5(o_orderkey::VARCHAR) AS src,
      length(repeat(o_orderpriority, 80))::INT AS long_note, least(length(repeat(o_orderpriority, 80)), 600)::INT AS note_chars, CASE WHEN o_orderkey % 2 = 0 THEN 'My collage' ELSE o_orderpriority END AS title, 3 + (o_orderkey % 2)::INT AS version
    FROM orders WHERE o_totalprice > 100000""",
)
def c2_public(spark, sf_dir):
    """A ticket's card, what a share says of it, and how a reader sees that."""
    _, tickets = _owned(spark, sf_dir)
    rows = store.cards(tickets).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), "id")
    key, note = F.col("id"), F.repeat("o_orderpriority", F.lit(80))
    image = F.struct(F.md5(key.cast("string").cast("binary")).alias("hash"), F.lit(200).alias("w"), (key % 90 + 20).cast("int").alias("h"))
    public = store.public_ticket(F.struct(F.lit("train").alias("type")), note, image, F.lit(None).cast("struct<hash:string>"), key.cast("string"))
    rows = rows.withColumn("public", public)
    seen = F.get(store.view_cards(F.lit("tok"), F.array("public")), 0)
    title = store.public_title(F.when(key % 2 == 0, "  ").otherwise(F.col("o_orderpriority")))
    return rows.select(
        "id", seen["aspect"].alias("aspect"), "kind", seen["src"].alias("src"), F.length(note).alias("long_note"), F.length("public.note").alias("note_chars"), title.alias("title"), store.bump(F.lit(3), key % 2 == 1).alias("version")
    )


@query(
    "e3_publishable",
    """SELECT o_orderkey AS ticket_id, 'b' || o_orderkey AS image, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN 'p' || o_orderkey END AS photo
    FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 6 <> 0""",
)
def e3_publishable(spark, sf_dir):
    """Every sixth ticket has no blurred image; photos are there for all but every fifth."""
    placements, tickets = _owned(spark, sf_dir)
    key = F.col("id")
    kept = lambda kind, mark: tickets.select(key.alias("ticket_id"), F.lit(kind).alias("kind"), F.concat(F.lit(mark), key.cast("string")).cast("binary").alias("bytes"))
    images = kept("blurred", "b").where("ticket_id % 6 <> 0").unionByName(kept("photo", "p").where("ticket_id % 5 <> 0"))
    return store.publishable(placements, tickets, images).select("ticket_id", F.col("image").cast("string"), F.col("photo").cast("string"))


@query("e8_collages_of", "SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_partkey = 7")
def e8_collages_of(spark, sf_dir):
    """Suppliers as collages, parts as their items."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("collage_id"), F.col("l_partkey").alias("ticket_id"))
    return store.collages_of(item, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), 7)


@query(
    "b2_touched",
    """WITH n AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 9 = 0)
    SELECT 'collages' AS what, count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM n)) AS hit FROM customer
    UNION ALL SELECT 'placements', count(*) + (SELECT count(*) FROM n), count(*) FILTER (WHERE o_orderkey % 9 = 0) FROM orders""",
)
def b2_touched(spark, sf_dir):
    """B2: every ninth placement moves to layer 99, twice, and gets one beside it."""
    placements, _ = _owned(spark, sf_dir)
    collages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("2001-01-01").cast("timestamp").alias("updated_at"))
    some = placements.where("ticket_id % 9 = 0")
    new = some.withColumns({"z": F.lit(98), "seq": F.lit(1)}).unionByName(some.withColumns({"z": F.lit(99), "seq": F.lit(2)})).unionByName(some.withColumns({"ticket_id": -F.col("ticket_id") - 1, "z": F.lit(5), "seq": F.lit(1)}))
    touched, after = store.put_placements(collages, placements, new, F.lit("2001-08-01").cast("timestamp"))
    one = touched.agg(F.count("*").alias("n"), F.count_if(F.year("updated_at") + F.month("updated_at") == 2009).alias("hit")).select(F.lit("collages").alias("what"), "n", "hit")
    return one.unionByName(after.agg(F.count("*").alias("n"), F.count_if(F.col("z") == 99).alias("hit")).select(F.lit("placements").alias("what"), "n", "hit"))


@query(
    "b6_publish",
    """WITH s AS (SELECT c_custkey, 't' || c_custkey AS token, 'own' || c_custkey % 10 AS owner FROM customer WHERE c_custkey % 3 <> 0)
    SELECT token, owner AS owner_hash, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'second' ELSE 'old' END AS title, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 2001 ELSE 1999 END AS updated FROM s
    UNION ALL SELECT 'f' || c_custkey, 'own' || c_custkey % 10, 'second', 2001 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0""",
)
def b6_publish(spark, sf_dir):
    """Two of three customers have a share; every other one publishes twice, every fifth with a wrong owner."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    mark = lambda m, x=key: F.concat(F.lit(m), x.cast("string"))
    shares = c.where("c_custkey % 3 <> 0").select(mark("t").alias("token"), mark("own", key % 10).alias("owner_hash"), F.lit("old").alias("title"), F.lit("{}").alias("manifest"), *[F.lit("1999-01-01").cast("timestamp").alias(n) for n in ("created_at", "updated_at")])
    owner = F.when((key % 5 == 0) & (key % 3 != 0), "stranger").otherwise(mark("own", key % 10))
    ask = lambda seq, title: c.where("c_custkey % 2 = 0").select((key * 2 + seq).alias("id"), mark("t").alias("token"), owner.alias("owner_hash"), F.lit(title).alias("title"), F.lit("{}").alias("manifest"), F.lit(seq).alias("seq"), mark("f").alias("fresh"))
    after, _ = share.publish(shares, ask(0, "first").unionByName(ask(1, "second")), F.lit("2001-08-01").cast("timestamp"))
    return after.select("token", "owner_hash", "title", F.year("updated_at").alias("updated"))


@query(
    "d2_admission",
    """SELECT c_custkey, c_custkey % 4 <> 0 AS token_ok, c_custkey % 5 <> 0 AS owner_ok,
      CASE WHEN c_custkey % 17 = 0 THEN 503 WHEN c_custkey % 6 = 0 THEN 401 WHEN c_custkey % 7 = 0 THEN 429 WHEN c_custkey % 8 = 0 THEN 400 ELSE 200 END AS share_status,
      CASE WHEN c_custkey % 4 = 0 THEN 404 WHEN c_custkey % 5 = 0 THEN 403 WHEN c_custkey % 9 = 0 THEN 413 WHEN c_custkey % 10 = 1 THEN 400 ELSE 200 END AS asset_status FROM customer""",
)
def d2_admission(spark, sf_dir):
    """D2, D3, D4."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.repeat(key.cast("string"), F.lit(20)).alias("long"))
    secret = F.substring(F.concat(F.lit("secret-of-customer-no-"), F.col("long")), 1, 60)
    token = F.concat(F.substring(F.concat("long", F.lit("abcdefghijklmnopqrstuv")), 1, 21), F.when(key % 4 == 0, "-").otherwise("z"))
    stored = F.sha2(F.when(key % 5 == 0, "other").otherwise(secret).cast("binary"), 256)
    faults = F.when(key % 8 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        "c_custkey", share.is_token(token).alias("token_ok"), share.owner_matches(secret, stored).alias("owner_ok"),
        share.share_status(key % 17 != 0, F.when(key % 6 == 0, "short").otherwise(secret), key % 7 != 0, faults).alias("share_status"),
        share.asset_status(share.is_token(token), share.owner_matches(secret, stored), F.when(key % 9 == 0, 4 << 20).otherwise(100), key % 10 != 1, F.lit(True)).alias("asset_status"),
    )


@query(
    "p1_faults",
    """SELECT 'key' AS what, o_custkey % 400 AS k, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'reference', o_custkey, count(*) FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey""",
)
def p1_faults(spark, sf_dir):
    """What a primary key and a foreign key would refuse."""
    o = table(spark, sf_dir, "orders")
    twice = share.key_faults(o.select((F.col("o_custkey") % 400).alias("k")), ["k"]).select(F.lit("key").alias("what"), "k", "n")
    there = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    lost = share.reference_faults(o.select("o_custkey"), there, "o_custkey").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return twice.unionByName(lost.select(F.lit("reference").alias("what"), "k", "n"))


@query("p11_events", "SELECT event_type AS key, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 DAY GROUP BY ALL UNION ALL SELECT 'extra', 1")
def p11_events(spark, sf_dir):
    """One event more, then all but those of the day before."""
    from quillet.streaming import live

    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return live.prune(share.add_event(events, "extra", now), "at", now).groupBy("key").agg(F.count("*").alias("n"))


@query("d7_live_boxes", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b1,b2,b3' WHEN 1 THEN 'b1,b3' ELSE 'b2' END AS ids FROM orders")
def d7_live_boxes(spark, sf_dir):
    box = lambda n: F.struct(F.lit(n).alias("id"))
    key = F.col("o_orderkey") % 3
    removed = F.when(key == 1, F.array(F.lit("b2"))).when(key == 2, F.array(F.lit("b3"), F.lit("b1"))).otherwise(F.array().cast("array<string>"))
    left = scan.live_boxes(F.array(box("b1"), box("b2"), box("b3")), removed)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(left, lambda b: b["id"]), ",").alias("ids"))


@query(
    "b6_outcomes",
    """WITH r AS (SELECT c_custkey * 2 + s AS id, s AS seq, c_custkey, c_custkey % 3 <> 0 AS known, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 'stranger' ELSE 'own' || c_custkey % 10 END AS owner, 'f' || c_custkey % 90 AS fresh
      FROM customer, (VALUES (0), (1)) AS v(s) WHERE c_custkey % 2 = 0),
    t AS (SELECT fresh, arg_min(owner, (seq, id)) AS taker FROM r WHERE NOT known GROUP BY fresh)
    SELECT id, CASE WHEN known AND owner = 'stranger' THEN 403 WHEN known THEN 200 WHEN owner <> taker THEN 403 ELSE 201 END AS status,
      CASE WHEN known AND owner <> 'stranger' THEN 't' || c_custkey WHEN NOT known AND owner = taker THEN fresh END AS token FROM r LEFT JOIN t USING (fresh)""",
)
def b6_outcomes(spark, sf_dir):
    """What each request comes to: replaced, added, refused for its owner, refused for a token that another took."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    named = lambda m, x: F.concat(F.lit(m), x.cast("string"))
    none = F.lit("1999-01-01").cast("timestamp")
    shares = c.where("c_custkey % 3 <> 0").select(named("t", key).alias("token"), named("own", key % 10).alias("owner_hash"), F.lit("old").alias("title"), F.lit("{}").alias("manifest"), none.alias("created_at"), none.alias("updated_at"))
    owner = F.when((key % 5 == 0) & (key % 3 != 0), "stranger").otherwise(named("own", key % 10))
    seqs = c.where("c_custkey % 2 = 0").withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = seqs.select((key * 2 + F.col("seq")).alias("id"), named("t", key).alias("token"), owner.alias("owner_hash"), F.lit("new").alias("title"), F.lit("{}").alias("manifest"), "seq", named("f", key % 90).alias("fresh"))
    return share.publish(shares, asked, F.lit("2001-08-01").cast("timestamp"))[1]


@query(
    "f19_stage_figures",
    """WITH l AS (SELECT string_split(text, chr(10)) AS ls FROM documents), w AS (SELECT unnest(ls) AS t FROM l), k AS (SELECT t FROM w WHERE length(t) >= 40)
    SELECT 'documents' AS stage, 'rows' AS figure, count(*)::BIGINT AS value FROM documents UNION ALL SELECT 'documents', 'characters', sum(length(text)) FROM documents
    UNION ALL SELECT 'lines', 'rows', count(*) FROM w UNION ALL SELECT 'long lines', 'rows', count(*) FROM k UNION ALL SELECT 'long lines', 'longest', max(length(t)) FROM k""",
)
def f19_stage_figures(spark, sf_dir):
    """three stages over all documents, counted while their rows pass once."""
    stages = metered.Stages()
    docs = stages.metered("documents", table(spark, sf_dir, "documents").select("text"), characters=F.sum(F.char_length("text")))
    split = stages.metered("lines", docs.select(F.explode(F.split("text", "\n")).alias("t")))
    kept = stages.metered("long lines", split.where("char_length(t) >= 40"), longest=F.max(F.char_length("t")))
    with stages.timed("write"):
        kept.write.format("noop").mode("overwrite").save()
    return stages.figures(spark)
