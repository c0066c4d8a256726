"""The query catalogue: each operator on the driver's tables, beside DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hash_column, integer_bucket_and_sign, integer_hash
from .functions.scalars import argmax_first, expm1_clamped, finite, restored, softmax_max, to_double, transformed
from .model.schedules import cosine_lr, onecycle_lr, step_lr
from .operators import encode, loss, metrics, scale, select, similar, skipgram, split, units, vocab, weights
from .operators.calibrate import calibration_sums
from .operators.cooccur import cooccurrence
from .plans.formula import lowered
from .plans.items import ItemEncoder
from .sources.io import from_one_table, from_two_tables
from .sources.roles import Roles
from .streaming.hashing import windowed_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Fixtures: orders are units, the parts in their line items are weighted items; also customers with orders, and labelled documents.
def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def ol_units(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("double").alias("custkey"))


def ol_obs(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").cast("string").alias("item"), F.col("l_quantity").alias("weight"), F.col("p_brand").alias("genus"), F.col("p_type").alias("family"), F.col("p_retailprice").alias("retail"))


def pairs(s, d):
    line, part = table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice"), table(s, d, "part").select("p_partkey", "p_retailprice")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return both.select((F.col("l_quantity") * F.col("p_retailprice")).alias("pred"), F.col("l_extendedprice").alias("target"))


def classes(s, d):
    """Three classes of orders by price; the prediction looks at the priority, the confidence at the key."""
    code = F.when(F.col("o_totalprice") < 100000, 0).when(F.col("o_totalprice") < 250000, 1).otherwise(2)
    return table(s, d, "orders").select(code.cast("long").alias("target"), (F.substring("o_orderpriority", 1, 1).cast("long") % 3).alias("pred"), ((F.col("o_orderkey") % 100).cast("double") / 100).alias("confidence"))


def scores(s, d):
    return table(s, d, "orders").select((F.col("o_custkey") % 1000).cast("double").alias("score"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).cast("long").alias("label"))


def logits(s, d):
    q = F.col("l_quantity")
    x = F.array(q / 10, (50 - q) / 10, F.col("l_tax") * 20)
    return table(s, d, "lineitem").select(x.alias("logits"), (F.col("l_linenumber") % 3).cast("long").alias("target"))


OBS = "obs AS (SELECT l_orderkey AS unit_id, CAST(l_partkey AS VARCHAR) AS item, l_quantity AS weight, p_brand AS genus, p_type AS family, p_retailprice AS retail FROM lineitem JOIN part ON l_partkey = p_partkey)"
UNITS = "units AS (SELECT o_orderkey AS unit_id, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status, CAST(o_custkey AS DOUBLE) AS custkey FROM orders)"
W = "w AS (SELECT unit_id, item, sum(coalesce(weight, 1.0)) AS weight FROM obs GROUP BY ALL)"
DOWN = "row_number() OVER (PARTITION BY unit_id ORDER BY weight DESC, item)"
UP = "row_number() OVER (PARTITION BY unit_id ORDER BY weight, item)"
PAIRS = "p AS (SELECT l_quantity * p_retailprice AS pred, l_extendedprice AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"
CLASSES = "c AS (SELECT CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 2 END AS BIGINT) AS target, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) % 3 AS pred, (o_orderkey % 100)::DOUBLE / 100 AS confidence FROM orders)"
SCORES = "s AS (SELECT CAST(o_custkey % 1000 AS DOUBLE) AS score, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS label FROM orders)"
LOGITS = "l AS (SELECT l_quantity / 10 AS a, (50 - l_quantity) / 10 AS b, l_tax * 20 AS c, l_linenumber % 3 AS target FROM lineitem)"


def h(w: str, seed: int) -> str:
    """The item hash in DuckDB."""
    m = "((xor(h, CASE WHEN b > 127 THEN b + 4294967040 ELSE b END) * 1540483477) & 4294967295)"
    return f"list_reduce(list_transform(range(1, octet_length(encode({w})) + 1), lambda i: ('0x' || substr(hex(encode({w})), CAST(2 * i - 1 AS INT), 2))::BIGINT), lambda h, b: xor({m}, {m} >> 15), {seed}::BIGINT)"


def hashed(items: str, dim: int, norm: str = "weight") -> str:
    return f"""n AS (SELECT unit_id, item, {norm} AS weight FROM {items}),
k AS (SELECT item, {h("item", 0)} % {dim} AS slot, CASE WHEN {h("item", 1)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT item FROM n))
SELECT unit_id, slot, round(sum(sign * weight), 6) + 0.0 AS value FROM n JOIN k USING (item) GROUP BY ALL"""


SHARE = "weight / CASE WHEN sum(weight) OVER (PARTITION BY unit_id) < 1e-8 THEN 1.0 ELSE sum(weight) OVER (PARTITION BY unit_id) END"
ALPHA_ITEM = "v AS (SELECT item AS value, row_number() OVER (ORDER BY item) AS idx FROM (SELECT DISTINCT item FROM obs))"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- sources, roles, joins, filters
@query(f"WITH {UNITS}, {OBS} SELECT unit_id, price, coalesce(n, 0) AS n, coalesce(total, 0.0::DOUBLE) AS total FROM units LEFT JOIN (SELECT unit_id, count(*) AS n, sum(weight) AS total FROM obs GROUP BY ALL) USING (unit_id)")
def unit_obs_left(s, d):
    per_unit = ol_obs(s, d).groupBy("unit_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
    return units.with_observations(ol_units(s, d).select("unit_id", "price"), per_unit, {"n": 0, "total": 0.0})


@query("SELECT l_orderkey AS unit_id, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def unit_first_occurrence(s, d):
    rows = units.first_occurrence(table(s, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return rows.select(F.col("l_orderkey").alias("unit_id"), "l_partkey", "l_quantity")


ROLES = Roles("unit_id", "item", weight="weight", genus="genus", family="family", covariates=("price",))


@query(f"WITH {UNITS}, {OBS} SELECT unit_id, price, item, weight, genus, family FROM units JOIN obs USING (unit_id)")
def role_projection(s, d):
    u, o = from_two_tables(ol_units(s, d), ol_obs(s, d), ROLES)
    return u.join(o, "unit_id")


@query("SELECT l_orderkey AS unit_id, l_extendedprice AS price, item, l_quantity AS weight FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) a JOIN (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS item, l_quantity FROM lineitem) b USING (l_orderkey) WHERE r = 1")
def one_table_source(s, d):
    roles = Roles("l_orderkey", "l_partkey", weight="l_quantity", covariates=("l_extendedprice",))
    u, o = from_one_table(table(s, d, "lineitem"), roles, ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return u.withColumnRenamed("l_extendedprice", "price").join(o, "unit_id")


@query(f"WITH {UNITS}, {OBS} SELECT count(*) AS n_units, (SELECT count(*) FROM obs) AS n_obs, (SELECT count(DISTINCT item) FROM obs) AS n_items, (SELECT count(DISTINCT genus) FROM obs) AS n_genus, (SELECT count(DISTINCT family) FROM obs) AS n_family FROM units")
def schema_summary(s, d):
    return units.schema_summary(ol_units(s, d), ol_obs(s, d))


@query("SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 0.0) AS value FROM customer")
def safe_cast_default(s, d):
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    return table(s, d, "customer").select("c_custkey", text.alias("t")).select("c_custkey", to_double("t", 0.0).alias("value"))


@query(f"WITH {UNITS}, {OBS} SELECT unit_id, item, weight FROM obs WHERE unit_id IN (SELECT unit_id FROM units WHERE status = 'F')")
def semi_filter_units(s, d):
    return units.restrict(ol_obs(s, d), ol_units(s, d).where("status = 'F'")).select("unit_id", "item", "weight")


@query(f"WITH {UNITS}, {OBS}, t AS (SELECT unit_id, CASE WHEN unit_id % 4 = 0 THEN NULL ELSE price END AS target FROM units) SELECT unit_id, count(*) AS n FROM obs WHERE unit_id IN (SELECT unit_id FROM t WHERE target IS NOT NULL) GROUP BY ALL")
def filter_by_target(s, d):
    u = ol_units(s, d).select("unit_id", F.when(F.col("unit_id") % 4 != 0, F.col("price")).alias("target"))
    return units.filter_by_target(u, ol_obs(s, d), "target")[1].groupBy("unit_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS unit_id, o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 AS has_target FROM orders")
def target_mask(s, d):
    x = F.when(F.col("unit_id") % 4 == 0, None).when(F.col("unit_id") % 9 == 0, float("nan")).otherwise(F.col("price"))
    return ol_units(s, d).withColumn("t", x).select("unit_id", units.has_target("t").alias("has_target"))


@query(f"WITH {OBS} SELECT item, weight, genus FROM obs WHERE unit_id = 77")
def obs_point_lookup(s, d):
    return units.observations_of(ol_obs(s, d), 77).select("item", "weight", "genus")


@query(f"WITH {OBS}, a AS (SELECT unit_id, sum(weight) AS parts FROM obs GROUP BY ALL), b AS (SELECT l_orderkey AS unit_id, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL) SELECT o_orderkey AS unit_id, coalesce(parts, 0.0::DOUBLE) AS parts, coalesce(suppliers, 0) AS suppliers FROM orders LEFT JOIN a ON o_orderkey = a.unit_id LEFT JOIN b ON o_orderkey = b.unit_id")
def multi_obs_tables(s, d):
    parts = ol_obs(s, d).groupBy("unit_id").agg(F.sum("weight").alias("parts"))
    suppliers = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.count_distinct("l_suppkey").alias("suppliers"))
    return units.with_observations(units.with_observations(ol_units(s, d).select("unit_id"), parts, {"parts": 0.0}), suppliers, {"suppliers": 0})


# --- weights and selection
@query(f"WITH {OBS}, {W} SELECT * FROM w")
def weight_sum_by_key(s, d):
    return weights.item_weights(ol_obs(s, d))


@query(f"WITH {OBS} SELECT unit_id, item, CAST(count(*) AS DOUBLE) AS weight FROM obs GROUP BY ALL")
def count_aggregation(s, d):
    return weights.item_weights(ol_obs(s, d), mode="count")


@query(f"WITH {OBS} SELECT unit_id, genus || ':' || family AS item, sum(weight) AS weight FROM obs GROUP BY ALL")
def composite_key_weights(s, d):
    return weights.item_weights(ol_obs(s, d), weights.composite_key("genus", "family"))


@query(f"WITH {OBS}, {W} SELECT unit_id, item, weight, CAST({DOWN} AS INT) AS rank FROM w QUALIFY rank <= 3")
def topk_items(s, d):
    return select.top(weights.item_weights(ol_obs(s, d)), 3)


@query(f"WITH {OBS}, {W} SELECT unit_id, item, weight, CAST({UP} AS INT) AS rank FROM w QUALIFY rank <= 2")
def bottomk_items(s, d):
    return select.bottom(weights.item_weights(ol_obs(s, d)), 2)


TOP_BOTTOM = f"tb AS (SELECT unit_id, item, weight, CASE WHEN r <= 2 THEN r - 1 WHEN n - r < 2 THEN 2 + n - r END AS slot FROM (SELECT *, {DOWN} AS r, count(*) OVER (PARTITION BY unit_id) AS n FROM w) WHERE slot IS NOT NULL)"


@query(f"WITH {OBS}, {W}, {TOP_BOTTOM} SELECT * FROM tb")
def top_bottom_items(s, d):
    return select.top_bottom(weights.item_weights(ol_obs(s, d)), 2, 2)


@query(f"WITH {OBS} SELECT unit_id, item, weight FROM obs")
def all_items(s, d):
    return select.selected(ol_obs(s, d).select("unit_id", "item", "weight"), "all")


@query(f"WITH {OBS} SELECT unit_id, item, weight, CAST({DOWN} AS INT) AS rank FROM obs QUALIFY rank <= 3")
def topk_records(s, d):
    return select.top(ol_obs(s, d).select("unit_id", "item", "weight"), 3)


@query(f"WITH {OBS}, {W} SELECT unit_id, item, round({SHARE}, 6) AS weight FROM w")
def norm_weights(s, d):
    return rounded(weights.normalised(weights.item_weights(ol_obs(s, d)), "norm"), "weight")


@query(f"WITH {OBS}, {W} SELECT unit_id, item, round(ln(1 + weight), 6) AS weight FROM w")
def log1p_weights(s, d):
    return rounded(weights.normalised(weights.item_weights(ol_obs(s, d)), "log1p"), "weight")


# --- vocabularies
@query(f"WITH {OBS} SELECT item AS value, row_number() OVER (ORDER BY count(*) DESC, item) AS idx FROM obs GROUP BY item")
def vocab_frequency(s, d):
    return vocab.by_frequency(ol_obs(s, d), "item")


@query(f"WITH {OBS} SELECT genus AS value, row_number() OVER (ORDER BY genus) AS idx FROM (SELECT DISTINCT genus FROM obs)")
def vocab_alpha(s, d):
    return vocab.alphabetical(ol_obs(s, d), "genus")


@query(f"WITH {OBS} SELECT item AS value, row_number() OVER (ORDER BY item) AS idx FROM obs GROUP BY item HAVING count(*) >= 30")
def vocab_min_count(s, d):
    return vocab.alphabetical(ol_obs(s, d), "item", min_count=30)


@query(f"WITH {OBS} SELECT item AS value, row_number() OVER (ORDER BY item) AS idx FROM obs GROUP BY item HAVING count(DISTINCT unit_id) >= 30")
def vocab_min_unit_freq(s, d):
    return vocab.in_units(ol_obs(s, d), "item", 30)


KNOWN = "v AS (SELECT item AS value, row_number() OVER (ORDER BY item) AS idx FROM obs GROUP BY item HAVING count(*) >= 30)"


@query(f"WITH {OBS}, {KNOWN} SELECT unit_id, item, coalesce(idx, 0) AS idx FROM obs LEFT JOIN v ON item = value")
def vocab_lookup_unknown(s, d):
    o = ol_obs(s, d)
    return vocab.encoded(o.select("unit_id", "item"), "item", vocab.alphabetical(o, "item", 30), "idx")


@query(f"WITH {OBS}, {KNOWN} SELECT DISTINCT item FROM obs WHERE item NOT IN (SELECT value FROM v)")
def unknown_items(s, d):
    o = ol_obs(s, d)
    return units.unknown_items(o, vocab.alphabetical(o, "item", 30)).select("item").distinct()


LOST = f"{KNOWN}, f AS (SELECT unit_id, sum(CASE WHEN idx IS NULL THEN weight ELSE 0 END) / sum(weight) AS unknown_fraction, count(*) FILTER (WHERE idx IS NULL) AS unknown_count FROM obs LEFT JOIN v ON item = value GROUP BY ALL)"


def _lost(s, d):
    o = ol_obs(s, d)
    return vocab.unknown_share(o, vocab.alphabetical(o, "item", 30))


@query(f"WITH {OBS}, {LOST} SELECT o_orderkey AS unit_id, round(coalesce(unknown_fraction, 0), 6) AS unknown_fraction FROM orders LEFT JOIN f ON o_orderkey = unit_id")
def unknown_fraction(s, d):
    return rounded(units.with_observations(ol_units(s, d).select("unit_id"), _lost(s, d).select("unit_id", "unknown_fraction"), {"unknown_fraction": 0.0}), "unknown_fraction")


@query(f"WITH {OBS}, {LOST} SELECT o_orderkey AS unit_id, coalesce(unknown_count, 0) AS unknown_count FROM orders LEFT JOIN f ON o_orderkey = unit_id")
def unknown_count(s, d):
    return units.with_observations(ol_units(s, d).select("unit_id"), _lost(s, d).select("unit_id", "unknown_count"), {"unknown_count": 0})


@query(f"WITH {OBS}, {UNITS}, {LOST} SELECT unit_id, round(1 - unknown_fraction, 6) AS confidence, CASE WHEN round(1 - unknown_fraction, 6) >= 0.5 THEN price END AS prediction FROM units JOIN f USING (unit_id)")
def confidence_filter(s, d):
    both = rounded(ol_units(s, d).join(_lost(s, d), "unit_id"), "confidence")
    return both.select("unit_id", "confidence", metrics.sure(F.col("price"), F.col("confidence"), 0.5).alias("prediction"))


# --- encoders
@query(f"WITH {OBS} SELECT item, {h('item', 0)} AS h0, {h('item', 1)} AS h1 FROM (SELECT DISTINCT item FROM obs)")
def hash_values(s, d):
    return ol_obs(s, d).select("item").distinct().select("item", hash_column("item", 0).alias("h0"), hash_column("item", 1).alias("h1"))


@query(f"WITH {OBS}, {W}, t AS (SELECT * FROM w QUALIFY {DOWN} <= 3), {hashed('t', 32, SHARE)}")
def hash_encode_norm(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 32, "top", 3), "value")


@query(f"WITH {OBS}, {W}, {hashed('w', 64)}")
def hash_encode_raw(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 64, norm="raw"), "value")


@query(f"WITH {OBS}, {W}, {hashed('w', 32, 'ln(1 + weight)')}")
def hash_encode_log1p(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 32, norm="log1p"), "value")


@query(f"WITH {OBS}, {W}, {TOP_BOTTOM}, {hashed('tb', 32, SHARE)}")
def hash_encode_topbottom(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 32, "top_bottom", 2, 2), "value")


@query(f"WITH {OBS}, t AS (SELECT unit_id, item, weight FROM obs QUALIFY {DOWN} <= 3), {hashed('t', 32, 'weight')}")
def hash_encode_records(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 32, "top", 3, norm="raw", dedupe="record"), "value")


@query(f"WITH {OBS}, w AS (SELECT unit_id, genus || ':' || family AS item, sum(weight) AS weight FROM obs GROUP BY ALL), {hashed('w', 32, SHARE)}")
def hash_encode_composite(s, d):
    return rounded(encode.hash_features(ol_obs(s, d), 32, key=weights.composite_key("genus", "family")), "value")


@query(f"WITH {OBS}, {W}, {ALPHA_ITEM} SELECT unit_id, r - 1 AS slot, idx FROM (SELECT *, {DOWN} AS r FROM w) JOIN v ON item = value WHERE r <= 3")
def embed_slots(s, d):
    o = ol_obs(s, d)
    return encode.embed_slots(o, vocab.alphabetical(o, "item"), 3)


def _embed_sql(c: str) -> str:
    return f"SELECT unit_id, '{c}' AS \"column\", r - 1 AS slot, idx FROM (SELECT unit_id, {c} AS item, sum(weight) AS weight, row_number() OVER (PARTITION BY unit_id ORDER BY sum(weight) DESC, {c}) AS r FROM obs GROUP BY unit_id, {c}) JOIN (SELECT {c} AS value, row_number() OVER (ORDER BY {c}) AS idx FROM (SELECT DISTINCT {c} FROM obs)) ON item = value WHERE r <= 2"


@query(f"WITH {OBS} {_embed_sql('genus')} UNION ALL {_embed_sql('family')}")
def embed_slots_multi(s, d):
    u, o = ol_units(s, d), ol_obs(s, d)
    return lowered("price ~ embed(genus, family, top=2)", u, o).fit(u, o).ids(u, o, "embed_genus_family")


TAXA = "g AS (SELECT genus AS gv, row_number() OVER (ORDER BY genus) AS genus_id FROM (SELECT DISTINCT genus FROM obs)), fa AS (SELECT family AS fv, row_number() OVER (ORDER BY family) AS family_id FROM (SELECT DISTINCT family FROM obs))"


@query(f"WITH {OBS}, {TAXA} SELECT unit_id, r - 1 AS slot, genus_id, family_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY weight DESC, item, genus, family) AS r FROM obs) JOIN g ON genus = gv JOIN fa ON family = fv WHERE r <= 3")
def taxonomy_slots(s, d):
    o = ol_obs(s, d)
    return encode.taxonomy_slots(o, vocab.alphabetical(o, "genus"), vocab.alphabetical(o, "family"), 3)


VECTOR = "x AS (SELECT unit_id, coalesce(idx, 0) AS idx, sum(weight) AS value FROM w LEFT JOIN v ON item = v.value GROUP BY unit_id, coalesce(idx, 0))"


@query(f"WITH {OBS}, {W}, {KNOWN}, {VECTOR} SELECT * FROM x")
def sparse_vector(s, d):
    o = ol_obs(s, d)
    return encode.sparse_vector(o, vocab.alphabetical(o, "item", 30))


@query(f"WITH {OBS}, {W}, {KNOWN}, {VECTOR} SELECT unit_id, idx, 1.0::DOUBLE AS value FROM x")
def presence_absence(s, d):
    o = ol_obs(s, d)
    return encode.sparse_vector(o, vocab.alphabetical(o, "item", 30), presence=True)


@query(f"WITH {OBS}, {W}, {KNOWN}, {VECTOR}, m AS (SELECT i AS idx, j AS slot, ((i * 7 + j * 3) % 11 - 5) / 10 AS weight FROM (SELECT idx AS i FROM v UNION ALL SELECT 0) a, range(0, 4) b(j)) SELECT unit_id, slot, round(sum(x.value * m.weight), 6) + 0.0 AS value FROM x JOIN m USING (idx) GROUP BY ALL")
def sparse_projection(s, d):
    o = ol_obs(s, d)
    known = vocab.alphabetical(o, "item", 30)
    ids = known.select(F.col("idx").cast("long").alias("idx")).unionByName(s.range(1).select(F.col("id").alias("idx")))  # 0: unknown items
    cells = ids.select("idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    matrix = cells.withColumn("slot", F.col("slot").cast("long")).withColumn("weight", ((F.col("idx") * 7 + F.col("slot") * 3) % 11 - 5) / 10)
    return rounded(encode.sparse_projection(encode.sparse_vector(o, known), matrix), "value")


@query(f"WITH {OBS}, {W}, {ALPHA_ITEM}, t AS (SELECT * FROM w QUALIFY {DOWN} <= 3), n AS (SELECT unit_id, item, {SHARE} AS share FROM t) SELECT unit_id, idx, round(share, 6) AS value FROM n JOIN v ON item = v.value")
def sparse_term(s, d):
    u, o = ol_units(s, d), ol_obs(s, d)
    return rounded(lowered("price ~ sparse(item, dim=4, top=3)", u, o).fit(u, o).sparse(u, o, "sparse_item", "item"), "value")


@query("""WITH a AS (SELECT p_partkey, CAST(CAST(p_partkey AS BIGINT) AS UHUGEINT) AS h FROM part),
b AS (SELECT p_partkey, (xor(h, h >> 33) * 18397679294719823053::UHUGEINT) & 18446744073709551615::UHUGEINT AS h FROM a),
c AS (SELECT p_partkey, (xor(h, h >> 33) * 14181476777654086739::UHUGEINT) & 18446744073709551615::UHUGEINT AS h FROM b),
e AS (SELECT p_partkey, CAST(xor(h, h >> 33) & 4294967295::UHUGEINT AS BIGINT) AS h FROM c),
f AS (SELECT p_partkey, CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS h FROM e)
SELECT p_partkey, h AS hash, abs(h) % 32 AS slot, CASE WHEN h >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM f""")
def hash_integer_ids(s, d):
    slot, sign = integer_bucket_and_sign(F.col("p_partkey"), 32)
    return table(s, d, "part").select("p_partkey", integer_hash(F.col("p_partkey")).alias("hash"), slot.alias("slot"), sign.alias("sign"))


PRIORITY = "v AS (SELECT priority AS value, row_number() OVER (ORDER BY priority) AS idx FROM (SELECT DISTINCT priority FROM units WHERE status <> 'P'))"


@query(f"WITH {UNITS}, v AS (SELECT status AS value, row_number() OVER (ORDER BY status) AS idx FROM (SELECT DISTINCT status FROM units WHERE unit_id % 2 = 0 AND status <> 'P')) SELECT unit_id, coalesce(idx, 0) AS slot, 1.0::DOUBLE AS value FROM units LEFT JOIN v ON status = value")
def onehot(s, d):
    u = ol_units(s, d)
    return encode.onehot(u, "status", vocab.alphabetical(u.where("unit_id % 2 = 0 and status <> 'P'"), "status"))


@query(f"WITH {OBS}, {TAXA} SELECT DISTINCT unit_id, genus_id AS slot, 1.0::DOUBLE AS value FROM obs JOIN g ON genus = gv")
def multihot_obs(s, d):
    o = ol_obs(s, d)
    return encode.multihot(o, "genus", vocab.alphabetical(o, "genus"))


@query(f"WITH {UNITS}, m AS (SELECT avg(price) AS a, stddev_pop(price) AS b FROM units) SELECT unit_id, round((price - a) / b, 6) + 0.0 AS price FROM units, m")
def numeric_zscore(s, d):
    u = ol_units(s, d).select("unit_id", "price")
    return rounded(scale.scaled(u, scale.fitted(u, ["price"], "population"), ["price"]), "price")


@query(f"WITH {UNITS} SELECT unit_id, 0 ::BIGINT AS slot, price AS value FROM units UNION ALL SELECT unit_id, 1, custkey FROM units")
def raw_passthrough(s, d):
    u = ol_units(s, d)
    from .plans.encoder import Encoder

    return Encoder().add_raw("raw", ["price", "custkey"]).fit(u).transform(u)


@query(f"WITH {OBS} SELECT unit_id, round(sum(retail * weight) / sum(weight), 6) AS value FROM obs GROUP BY ALL")
def obs_numeric_weighted_mean(s, d):
    return rounded(encode.weighted_mean(ol_obs(s, d), "retail"), "value")


@query(f"WITH {OBS}, {UNITS}, {W}, u AS (SELECT unit_id, slot, value FROM (SELECT unit_id, 0::BIGINT AS slot, (price - (SELECT avg(price) FROM units)) / (SELECT stddev_pop(price) FROM units) AS value FROM units)), e AS ({hashed('w', 16, SHARE).replace('n AS (', 'WITH n AS (', 1)}), o AS (SELECT unit_id, 17 + coalesce(idx, 0) AS slot, 1.0::DOUBLE AS value FROM units LEFT JOIN (SELECT status AS sv, row_number() OVER (ORDER BY status) AS idx FROM (SELECT DISTINCT status FROM units)) ON status = sv) SELECT unit_id, slot, round(value, 6) + 0.0 AS value FROM (SELECT * FROM u UNION ALL SELECT unit_id, slot + 1, value FROM e UNION ALL SELECT * FROM o)")
def formula_features(s, d):
    u, o = ol_units(s, d), ol_obs(s, d)
    return rounded(lowered("price ~ price + hash(item, dim=16) + onehot(status)", u, o).fit(u, o).transform(u, o), "value")


@query(f"WITH {OBS}, {UNITS}, {LOST}, g AS (SELECT unit_id, [coalesce(custkey, 0.0), price, coalesce(unknown_fraction, 0.0), CAST(coalesce(unknown_count, 0) AS DOUBLE)] AS x FROM units LEFT JOIN f USING (unit_id)) SELECT unit_id, len(x) AS width, round(x[1], 6) AS first, x[2] AS second, round(x[3], 6) AS third, x[4] AS fourth FROM g")
def feature_assembly(s, d):
    x = encode.assembled(ol_units(s, d), ["custkey", "price"], _lost(s, d), ["unknown_fraction", "unknown_count"], "x")
    cells = [F.get("x", F.lit(k)).alias(name) for k, name in enumerate(("first", "second", "third", "fourth"))]
    return rounded(x.select("unit_id", F.size("x").cast("long").alias("width"), *cells), "first", "third")


@query(f"WITH {OBS}, k AS (SELECT p_partkey::VARCHAR AS item, [p_size / 50.0, p_retailprice / 1000.0]::DOUBLE[] AS v FROM part WHERE p_partkey % 4 <> 0) SELECT unit_id, round(coalesce(sum(weight * v[1]) / sum(CASE WHEN v IS NOT NULL THEN weight END), 0), 6) AS first, round(coalesce(sum(weight * v[2]) / sum(CASE WHEN v IS NOT NULL THEN weight END), 0), 6) AS second, round(1 - coalesce(sum(CASE WHEN v IS NOT NULL THEN weight END), 0) / sum(weight), 6) AS unknown_fraction FROM obs LEFT JOIN k USING (item) GROUP BY unit_id")
def pretrained_vectors(s, d):
    known = table(s, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("item"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("vector"))
    x = encode.pooled_vectors(ol_obs(s, d), known, 2, by="weight")
    return rounded(x.select("unit_id", F.get("vector", F.lit(0)).alias("first"), F.get("vector", F.lit(1)).alias("second"), "unknown_fraction"), "first", "second", "unknown_fraction")


FREQUENT = "v AS (SELECT item AS value, row_number() OVER (ORDER BY item) AS idx FROM obs GROUP BY item HAVING count(DISTINCT unit_id) >= 20)"


@query(f"WITH {OBS}, w AS (SELECT unit_id, item, CAST(count(*) AS DOUBLE) AS weight FROM obs GROUP BY ALL), {FREQUENT}, t AS (SELECT unit_id, item, ln(1 + weight) AS weight FROM w QUALIFY {UP} <= 3) SELECT unit_id, coalesce(idx, 0) AS slot, round(sum(t.weight), 6) AS value FROM t LEFT JOIN v ON item = value GROUP BY ALL")
def item_encoder_sparse(s, d):
    o = ol_obs(s, d)
    fitted = ItemEncoder(k=3, selection="bottom", representation="sparse", norm="log1p", aggregation="count", min_units=20).fit(o)
    return rounded(fitted.transform(o), "value")


@query(f"WITH {OBS}, w AS (SELECT unit_id, item, CAST(count(*) AS DOUBLE) AS weight FROM obs GROUP BY ALL), {FREQUENT}, {TOP_BOTTOM} SELECT unit_id, slot, coalesce(idx, 0) AS value FROM tb LEFT JOIN v ON item = value")
def item_encoder_embed(s, d):
    o = ol_obs(s, d)
    return ItemEncoder(k=2, selection="top_bottom", representation="embed", aggregation="count", min_units=20).fit(o).transform(o)


@query(f"WITH {OBS}, {W}, {FREQUENT} SELECT unit_id, r - 1 AS slot, coalesce(idx, 0) AS value FROM (SELECT *, {UP} AS r FROM w) LEFT JOIN v ON item = value WHERE r <= 2")
def item_encoder_embed_bottom(s, d):
    o = ol_obs(s, d)
    return ItemEncoder(k=2, selection="bottom", representation="embed", min_units=20).fit(o).transform(o)


@query(f"WITH {OBS}, {W}, {FREQUENT} SELECT unit_id, {DOWN} - 1 AS slot, coalesce(idx, 0) AS value FROM w LEFT JOIN v ON item = value")
def item_encoder_embed_all(s, d):
    o = ol_obs(s, d)
    return ItemEncoder(selection="all", representation="embed", min_units=20).fit(o).transform(o)


@query(f"WITH {OBS}, {W}, t AS (SELECT * FROM w QUALIFY {UP} <= 2), {hashed('t', 16, 'ln(1 + weight)')}")
def item_encoder_hash(s, d):
    o = ol_obs(s, d)
    return rounded(ItemEncoder(dim=16, k=2, selection="bottom", norm="log1p").fit(o).transform(o), "value")


@query(f"WITH {OBS}, {W}, {FREQUENT}, t AS (SELECT * FROM w QUALIFY {DOWN} <= 3) SELECT DISTINCT unit_id, coalesce(idx, 0) AS slot, 1.0::DOUBLE AS value FROM t LEFT JOIN v ON item = value")
def item_encoder_presence(s, d):
    o = ol_obs(s, d)
    return ItemEncoder(k=3, selection="top", representation="presence", min_units=20).fit(o).transform(o)


@query("SELECT unit_id, sum(weight) AS weight, n AS n_rows FROM (SELECT l_orderkey AS unit_id, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, 1.0) AS weight, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY ALL")
def null_weight_default(s, d):
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").cast("string").alias("item"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("weight"))
    rows = o.groupBy("unit_id").agg(F.count("*").alias("n_rows"))
    return weights.item_weights(o).groupBy("unit_id").agg(F.sum("weight").alias("weight")).join(rows, "unit_id")


@query(f"WITH {UNITS}, a AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 7), (4, 33)) t(place, unit_id)) SELECT CAST(a.place AS BIGINT) AS place, CAST(a.unit_id AS BIGINT) AS unit_id, price, status FROM a LEFT JOIN units ON a.unit_id = units.unit_id")
def requested_rows(s, d):
    return units.requested(ol_units(s, d), [7, 3, 999_999_999, 7, 33]).select("place", F.col("unit_id").cast("long").alias("unit_id"), "price", "status")


# --- scaling, transforms, splits
@query("SELECT round(avg(x), 6) AS x_mean, round(CASE WHEN stddev_samp(x) < 1e-8 THEN 1.0 ELSE stddev_samp(x) END, 6) AS x_scale, 3.0::DOUBLE AS y_mean, 1.0::DOUBLE AS y_scale FROM (SELECT o_totalprice / 1000 AS x FROM orders)")
def scaler_sample_guarded(s, d):
    u = table(s, d, "orders").select((F.col("o_totalprice") / 1000).alias("x"), F.lit(3.0).alias("y"))
    return rounded(scale.fitted(u, ["x", "y"], "sample_guarded"), "x_mean", "x_scale", "y_mean", "y_scale")


@query("SELECT round(avg(o_totalprice), 4) AS price_mean, round(stddev_samp(o_totalprice) + 1e-8, 4) AS price_scale FROM orders")
def scaler_sample(s, d):
    return rounded(scale.fitted(ol_units(s, d), ["price"]), "price_mean", "price_scale", digits=4)


@query("SELECT round(avg(o_totalprice), 4) AS price_mean, round(stddev_pop(o_totalprice), 4) AS price_scale FROM orders")
def scaler_population(s, d):
    return rounded(scale.fitted(ol_units(s, d), ["price"], "population"), "price_mean", "price_scale", digits=4)


@query("SELECT o_orderkey AS unit_id, round(o_totalprice, 4) AS price FROM orders")
def zscore_inverse(s, d):
    u = ol_units(s, d).select("unit_id", "price")
    m = scale.fitted(u, ["price"])
    return rounded(scale.restored(scale.scaled(u, m, ["price"]), m, ["price"]), "price", digits=4)


@query("WITH t AS (SELECT o_orderkey AS unit_id, ln(1 + o_totalprice) AS y FROM orders), m AS (SELECT avg(y) AS a, stddev_samp(y) + 1e-8 AS b FROM t) SELECT unit_id, round((y - a) / b, 6) + 0.0 AS y FROM t, m")
def target_log1p_scale(s, d):
    u = ol_units(s, d).select("unit_id", transformed("price", "log1p").alias("y"))
    return rounded(scale.scaled(u, scale.fitted(u, ["y"]), ["y"]), "y")


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(exp(greatest(least((l_quantity - 25) / 4, 88), -88)) - 1, 6) AS value FROM lineitem")
def expm1_clamped_values(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(expm1_clamped((F.col("l_quantity") - 25) / 4), 6).alias("value"))


@query("SELECT o_orderkey AS unit_id, round(sqrt(o_totalprice), 6) AS root, round(o_totalprice, 4) AS price FROM orders")
def sqrt_roundtrip(s, d):
    u = ol_units(s, d).withColumn("root", transformed("price", "sqrt"))
    return u.select("unit_id", F.round("root", 6).alias("root"), F.round(restored("root", "sqrt"), 4).alias("price"))


SPLIT = f"t AS (SELECT o_orderkey AS unit_id, row_number() OVER (ORDER BY {h(chr(39) + '42|' + chr(39) + ' || CAST(o_orderkey AS VARCHAR)', 0)}, o_orderkey) AS position FROM orders), z AS (SELECT unit_id, position > (SELECT count(*) FROM t) - floor((SELECT count(*) FROM t) * 0.2) AS is_test FROM t)"


@query(f"WITH {SPLIT} SELECT * FROM z")
def split_assignment(s, d):
    return split.train_test(ol_units(s, d).select("unit_id"), 0.2, 42)


@query(f"WITH {SPLIT} SELECT is_test, count(*) AS n FROM z GROUP BY ALL")
def split_counts(s, d):
    return split.train_test(ol_units(s, d).select("unit_id"), 0.2, 42).groupBy("is_test").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS unit_id, {h(chr(39) + '7|' + chr(39) + ' || CAST(o_orderkey AS VARCHAR)', 0)} % 5 AS fold FROM orders")
def kfold_assignment(s, d):
    return split.folds(ol_units(s, d).select("unit_id"), 5, 7)


@query("SELECT o_orderkey AS unit_id, code FROM orders JOIN (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON o_orderpriority = p")
def class_codes(s, d):
    return split.class_codes(ol_units(s, d), "priority").select("unit_id", "code")


# --- metrics and losses
def _metric(name: str, column, sql: str, digits: int = 4):
    def run(s, d):
        return pairs(s, d).agg(F.round(column(), digits).alias("value"))

    run.__name__ = name
    query(f"WITH {PAIRS} SELECT round({sql}, {digits}) AS value FROM p")(run)


_metric("m_mae", metrics.mae, "avg(abs(pred - target))")
_metric("m_rmse", metrics.rmse, "sqrt(avg((pred - target) * (pred - target)))")
_metric("m_smape", metrics.smape, "avg(abs(pred - target) / (abs(pred) + abs(target) + 1e-8))", 6)
_metric("m_smape_half", lambda: metrics.smape("half"), "avg(abs(pred - target) / ((abs(pred) + abs(target)) / 2 + 1e-8))", 6)
_metric("m_r2", metrics.r2, "1 - sum((pred - target) * (pred - target)) / (var_pop(target) * count(target))", 6)
_metric("m_band", lambda: metrics.band(0.25), "avg(CASE WHEN pred / (target + 1e-8) BETWEEN 0.75 AND 1.25 THEN 1.0 ELSE 0.0 END)", 6)
_metric("l_phased", lambda: loss.phased(400), "avg(abs(pred - target)) + 0.15 * avg(abs(pred - target) / (abs(pred) + abs(target) + 1e-8)) + 0.05 * (1 - avg(CASE WHEN pred / (target + 1e-8) BETWEEN 0.75 AND 1.25 THEN 1.0 ELSE 0.0 END))")
_metric("l_huber", lambda: loss.huber(1000.0), "avg(CASE WHEN abs(pred - target) <= 1000 THEN 0.5 * (pred - target) * (pred - target) ELSE 1000 * (abs(pred - target) - 500) END)", 2)
_metric("l_multitask", lambda: loss.multitask({"a": (1.0, metrics.mae()), "b": (0.5, metrics.smape())}), "avg(abs(pred - target)) + 0.5 * avg(abs(pred - target) / (abs(pred) + abs(target) + 1e-8))")


@query(f"WITH {PAIRS}, q AS (SELECT * FROM p WHERE target >= 2000) SELECT round(avg(CASE WHEN abs(pred - target) / greatest(abs(target), 1e-8) <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS value FROM q")
def m_band_finite(s, d):
    df = pairs(s, d).withColumn("target", F.when(F.col("target") < 2000, float("nan")).otherwise(F.col("target")))
    return metrics.finite_pairs(df).agg(F.round(metrics.band(0.1, "finite"), 6).alias("value"))


def _regression_sql() -> str:
    cells = {"mae": "avg(abs(pred - target))", "rmse": "sqrt(avg((pred - target) * (pred - target)))", "r2": "1 - sum((pred - target) * (pred - target)) / (var_pop(target) * count(target))", "smape": "avg(abs(pred - target) / (abs(pred) + abs(target) + 1e-8))"}
    cells |= {f"band_{b}": f"avg(CASE WHEN pred / (target + 1e-8) BETWEEN {1 - b / 100} AND {1 + b / 100} THEN 1.0 ELSE 0.0 END)" for b in (25, 50, 75)}
    return f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({v}, 4) AS value FROM p" for k, v in cells.items())


@query(_regression_sql())
def m_compute_regression(s, d):
    return rounded(metrics.regression(pairs(s, d)), "value", digits=4)


@query(f"WITH {PAIRS} SELECT round(0.8 * avg(abs(pred - target)) + 0.15 * avg(abs(pred - target) / greatest((abs(pred) + abs(target)) / 2 + 1e-8, 1e-7)) + 0.05 * avg(greatest(abs(pred - target) / greatest(abs(target), 1e-7) - 0.25, 0)), 4) AS loss FROM p")
def l_phase_config(s, d):
    return rounded(loss.phase_loss(pairs(s, d), loss.PRESETS["combined"]), "loss", digits=4)


@query(f"WITH {CLASSES} SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) AS value FROM c")
def m_accuracy(s, d):
    return classes(s, d).agg(F.round(metrics.accuracy(), 6).alias("value"))


@query(f"WITH {CLASSES} SELECT target, pred, count(*) AS n FROM c GROUP BY ALL")
def m_confusion(s, d):
    return metrics.confusion(classes(s, d), 3)


PER_CLASS = "k AS (SELECT i AS class, (SELECT count(*) FROM c WHERE target = i AND pred = i) AS tp, (SELECT count(*) FROM c WHERE target = i) AS support, (SELECT count(*) FROM c WHERE pred = i) AS picked FROM range(4) r(i)), m AS (SELECT class, coalesce(tp / nullif(picked, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM k), f1 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)"


@query(f"WITH {CLASSES}, {PER_CLASS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f1")
def m_per_class(s, d):
    return rounded(metrics.per_class(classes(s, d), 4), "precision", "recall", "f1")


@query(f"WITH {CLASSES}, {PER_CLASS}, o AS (SELECT avg(precision) AS p, avg(recall) AS r, sum(f1 * support) / sum(support) AS w FROM f1 WHERE support > 0) SELECT round(2 * p * r / (p + r), 6) AS macro_f1, round(w, 6) AS weighted_f1 FROM o")
def m_macro_weighted_f1(s, d):
    return rounded(metrics.f1_scores(classes(s, d), 4), "macro_f1", "weighted_f1")


COVER = "SELECT CAST(t AS DOUBLE) AS threshold, round(coalesce(count(*) FILTER (WHERE confidence >= t AND pred = target) / nullif(count(*) FILTER (WHERE confidence >= t), 0), 0.0), 6) AS accuracy, round(count(*) FILTER (WHERE confidence >= t) / count(*), 6) AS coverage, count(*) FILTER (WHERE confidence >= t) AS n_samples, count(*) AS n_total FROM c, (SELECT unnest({}) AS t) GROUP BY t"


@query(f"WITH {CLASSES} {COVER.format('[0.65]')}")
def m_acc_at_threshold(s, d):
    return rounded(metrics.coverage(classes(s, d), (0.65,)), "accuracy", "coverage")


@query(f"WITH {CLASSES} {COVER.format('[0.0, 0.5, 0.8, 0.9, 0.95]')}")
def m_coverage_curve(s, d):
    return rounded(metrics.coverage(classes(s, d)), "accuracy", "coverage")


@query(f"WITH {CLASSES}, {PER_CLASS.replace('range(4)', 'range(3)')}, o AS (SELECT avg(precision) AS p, avg(recall) AS r, sum(f1 * support) / sum(support) AS w FROM f1 WHERE support > 0) SELECT 'accuracy' AS metric, round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) AS value FROM c UNION ALL SELECT 'macro_f1', round(2 * p * r / (p + r), 6) FROM o UNION ALL SELECT 'weighted_f1', round(w, 6) FROM o UNION ALL SELECT 'precision_' || class, round(precision, 6) FROM f1 UNION ALL SELECT 'recall_' || class, round(recall, 6) FROM f1 UNION ALL SELECT 'f1_' || class, round(f1, 6) FROM f1")
def m_compute_classification(s, d):
    return rounded(metrics.classification(classes(s, d), 3), "value")


STEPS = f"WITH {SCORES}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY ALL), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp FROM g)"


@query(f"{STEPS} SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc FROM c")
def m_roc_auc(s, d):
    return rounded(metrics.roc_auc(scores(s, d)), "roc_auc")


@query(f"{STEPS} SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS pr_auc FROM c")
def m_pr_auc(s, d):
    return rounded(metrics.pr_auc(scores(s, d)), "pr_auc")


CE = "ln(exp(a) + exp(b) + exp(c)) - CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END"


@query(f"WITH {LOGITS} SELECT round(avg({CE}), 6) AS loss FROM l")
def l_cross_entropy(s, d):
    return logits(s, d).agg(F.round(loss.cross_entropy(), 6).alias("loss"))


@query(f"WITH {LOGITS} SELECT round(sum(CASE target WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END * ({CE})) / sum(CASE target WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END), 6) AS loss FROM l")
def l_class_weighted_ce(s, d):
    return logits(s, d).agg(F.round(loss.cross_entropy((1.0, 2.0, 0.5)), 6).alias("loss"))


# --- model side
@query(f"WITH {LOGITS} SELECT target, a, b, c, round(greatest(exp(a), exp(b), exp(c)) / (exp(a) + exp(b) + exp(c)), 6) AS confidence FROM (SELECT CAST(target AS BIGINT) AS target, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM l)")
def softmax_confidence(s, d):
    x = logits(s, d).select("target", F.transform("logits", lambda v: F.round(v, 4)).alias("x"))
    return x.select("target", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate("abc")], F.round(softmax_max("x"), 6).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(CASE WHEN l_linenumber >= l_quantity AND l_linenumber >= 3 THEN 0 WHEN l_quantity >= 3 THEN 1 ELSE 2 END AS BIGINT) AS best FROM lineitem")
def argmax_first_max(s, d):
    x = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.lit(3.0))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", argmax_first(x).alias("best"))


@query("WITH t AS (SELECT l_partkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY ALL) SELECT l_partkey, v[CAST(floor(0.05 * len(v)) AS BIGINT) + 1] AS low, v[len(v) // 2 + 1] AS mid, v[CAST(floor(0.95 * len(v)) AS BIGINT) + 1] AS high FROM t")
def mc_quantiles(s, d):
    return metrics.intervals(table(s, d, "lineitem"), "l_partkey", "l_extendedprice")


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(range(1, len(embedding) + 1), lambda i: (i % 5 - 2) / 10)) + 0.25, 6) AS value FROM embeddings")
def linear_head_forward(s, d):
    import numpy as np

    from .model.nn import Network
    from .model.passes import scored

    rows = table(s, d, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    wide = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    net = Network(wide, [], (), {"value": 1})
    net.p["hw_value"], net.p["hb_value"] = ((np.arange(1, wide + 1) % 5 - 2) / 10)[:, None], np.array([0.25])
    return rounded(scored(rows, net, "value", "embedding").select("vec_id", F.get("scores", F.lit(0)).alias("value")), "value")


@query("WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS query, b.id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id) SELECT query, id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INT) AS rank FROM p QUALIFY rank <= 5")
def latent_cosine_knn(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(similar.nearest(v, v.where("id % 100 = 0"), 5), "similarity")


@query("WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS query, b.id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id) SELECT query AS id, round(1 - avg(similarity), 6) AS score FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 10) GROUP BY query")
def latent_outliers(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(similar.outliers(v, v.where("id % 100 = 0")), "score")


@query()
def latent_clusters(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similar.clusters(v, 4)


@query(f"WITH {OBS}, o AS (SELECT DISTINCT unit_id, genus AS item FROM obs) SELECT x.item AS a, y.item AS b, count(*) AS n FROM o x JOIN o y ON x.unit_id = y.unit_id AND x.item < y.item GROUP BY ALL HAVING count(*) >= 2")
def item_cooccurrence(s, d):
    return cooccurrence(ol_obs(s, d).select("unit_id", F.col("genus").alias("item")), 2)


@query("WITH o AS (SELECT DISTINCT l_orderkey AS unit_id, l_partkey AS item FROM lineitem) SELECT x.item AS a, y.item AS b, count(*) AS n FROM o x JOIN o y ON x.unit_id = y.unit_id AND x.item < y.item GROUP BY ALL HAVING count(*) >= 2")
def item_cooccurrence_parts(s, d):
    return cooccurrence(table(s, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("item")), 2)


@query("SELECT o_orderkey AS unit_id, round(0.001 * pow(0.1, (o_orderkey % 500) // 100), 10) AS lr FROM orders")
def lr_step(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.round(step_lr(F.col("o_orderkey") % 500, 1e-3, 100, 0.1), 10).alias("lr"))


@query("SELECT o_orderkey AS unit_id, round(1e-6 + (0.001 - 1e-6) * 0.5 * (1 + cos(pi() * (o_orderkey % 500) / 500)), 10) AS lr FROM orders")
def lr_cosine(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.round(cosine_lr(F.col("o_orderkey") % 500, 1e-3, 1e-6, 500), 10).alias("lr"))


@query("SELECT unit_id, round(CASE WHEN i <= 150 THEN 0.01 / 25 + i / 150 * (0.01 - 0.01 / 25) ELSE 0.01 / 1e4 + 0.5 * (1 + cos(pi() * (i - 150) / 350)) * (0.01 - 0.01 / 1e4) END, 10) AS lr FROM (SELECT o_orderkey AS unit_id, o_orderkey % 501 AS i FROM orders)")
def lr_onecycle(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.round(onecycle_lr(F.col("o_orderkey") % 501, 0.01, 500), 10).alias("lr"))


@query("WITH e AS (SELECT date_trunc('hour', ts) AS t, user_id AS unit_id, event_type AS item, value AS weight FROM events), " + f"k AS (SELECT item, {h('item', 0)} % 16 AS slot, CASE WHEN {h('item', 1)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT item FROM e)) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS hour, unit_id, slot, round(sum(sign * weight), 4) + 0.0 AS value FROM e JOIN k USING (item) GROUP BY ALL")
def windowed_hash_features(s, d):
    e = table(s, d, "events").select("ts", F.col("user_id").alias("unit_id"), F.col("event_type").alias("item"), F.col("value").alias("weight"))
    out = windowed_hash(e, 16)
    return rounded(out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "unit_id", "slot", "value"), "value", digits=4)


@query("SELECT count(*) AS n_valid FROM lineitem WHERE l_linenumber <> 3")
def finite_filter(s, d):
    x = F.when(F.col("l_linenumber") == 3, float("inf")).otherwise(F.col("l_quantity"))
    return table(s, d, "lineitem").where(finite(x)).agg(F.count("*").alias("n_valid"))


@query("""WITH r AS (SELECT [o_totalprice / 100000, (o_orderkey % 7) / 2.0, (o_custkey % 5) * 1.0]::DOUBLE[] AS z, CASE WHEN o_totalprice < 100000 THEN 2 WHEN o_totalprice < 250000 THEN 1 ELSE 0 END AS t FROM orders),
p AS (SELECT list_transform(z, lambda x: x - list_max(z)) AS z, z[t + 1] - list_max(z) AS y FROM r),
e AS (SELECT y, list_sum(list_transform(z, lambda x: exp(0.5 * x))) AS s0, list_sum(list_transform(z, lambda x: x * exp(0.5 * x))) AS s1, list_sum(list_transform(z, lambda x: x * x * exp(0.5 * x))) AS s2 FROM p)
SELECT count(*) AS n, round(avg(ln(s0) - 0.5 * y), 6) AS loss, round(avg(s1 / s0 - y), 6) AS slope, round(avg(s2 / s0 - (s1 / s0) * (s1 / s0)), 6) AS curvature FROM e""")
def temperature_step(s, d):
    z = F.array(F.col("o_totalprice") / 100000, (F.col("o_orderkey") % 7) / 2.0, (F.col("o_custkey") % 5).cast("double"))
    target = F.when(F.col("o_totalprice") < 100000, 2).when(F.col("o_totalprice") < 250000, 1).otherwise(0)
    return rounded(calibration_sums(table(s, d, "orders").select(z.alias("logits"), target.alias("target")), 0.5), "loss", "slope", "curvature")


# --- rows only: training, and models that SQL can't express
@query()
def train_predict_regression(s, d):
    from .model.train import Trainer
    from .sources.roles import Target

    u, o = ol_units(s, d), ol_obs(s, d)
    t = Trainer("price ~ custkey + hash(item, dim=16, top=3)", [Target.regression("price", "log1p")], epochs=4, hidden=(32, 16))
    t.fit(u, o)
    return t.predict(u, o)


@query()
def train_predict_classification(s, d):
    from .model.train import Trainer
    from .sources.roles import Target

    u, o = ol_units(s, d), ol_obs(s, d)
    u = split.class_codes(u, "priority").withColumnRenamed("code", "level")
    t = Trainer("level ~ price + embed(genus, top=2)", [Target.classification("level", 5)], epochs=3, hidden=(16,))
    t.fit(u, o)
    return t.predict(u, o)


@query()
def word2vec_items(s, d):
    return similar.item_vectors(ol_obs(s, d).select("unit_id", "item", "weight"), 8).getVectors().select(F.col("word").alias("item"), F.col("vector").cast("string").alias("vector"))


@query()
def skipgram_items(s, d):
    return skipgram.item_vectors(table(s, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").cast("string").alias("item"), F.col("l_quantity").alias("weight")), dim=8, epochs=1)


@query()
def pca_latent(s, d):
    return similar.principal_components(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 3)
