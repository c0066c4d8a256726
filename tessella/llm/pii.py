"""Personal data: fixed patterns, and terms that give protected entities away, in DataFrame operations alone.

Base spans are e-mail and IP addresses, card and phone numbers. They stand for
protected entities at three levels: the exact value, its pool (mail domain, network,
card issuer, dialling prefix) and its kind, so that a term can give away a group of
people whose values all differ. By information theory a term t discloses entity c to
the degree PMI(c; t) / IC(c), where IC(c) = log(N / n_c) and PMI(c; t) =
log(P(c | t) N / n_c): 0 if the term says nothing, 1 if whoever reads it knows c.
P(c | t) is the share of t's documents in which it stands near c, taken at the lower
end of its one-sided 95% Wilson interval (``Z``), which is smoothing and significance test in one: few
documents prove little. A term is a span wherever it occurs if it stands in ``SUPPORT``
different contexts of an entity, discloses it to ``DISCLOSURE`` or more, and makes it
likelier than not (``POSTERIOR``). Co-occurrence (within ``CONTEXT`` characters) and document
counts are taken over the whole corpus. ``sanitised`` generalises base spans to their
kind and removes such terms.

Entities' contexts bound a term's disclosure from above (documents in which it is
near any entity are at most those it occurs in), which leaves few candidates;
only their occurrences are sought in the second scan of the texts. Matching is
linear in the text: patterns are possessive where that changes nothing, and
cannot restart inside a run that has failed. Candidates are broadcast up to
``BROADCAST`` of them and joined by shuffle beyond. Texts stay where they are: only
documents that hold a disclosing term are joined with their terms, by broadcast
where these are few.

Edge cases: null texts are empty and have no spans; base spans of different kinds may
overlap, terms inside base spans are no spans of their own; repeated rows count as one
document in co-occurrence and give equal rows; an empty table gives none;
positions count code points; null ids are ids like others; other columns, whatever
their names, are kept by ``sanitised`` and ignored by ``find_pii``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small, written

KINDS = ["email", "ip", "card", "phone", "term"]
CONTEXT, SUPPORT, DISCLOSURE, POSTERIOR, Z, BROADCAST = 48, 3, 0.9, 0.5, 1.645, 100_000
#: The contract's patterns, in possessive form; a match may begin only at a run's start or at the last match's end.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(x: Column, i: Column) -> Column:
        d = x.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), weight)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        d = _digits(x)
        return F.length(d).between(12, 19) & _luhn(F.when(F.length(d).between(12, 19), d).otherwise(""))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _checked(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _located(text: Column, pattern: Column, kind: int) -> Column:
    """All matches with their places: lengths of what lies between the matches, added up."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(matches)), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.aggregate(zipped, zero, add)["out"]


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind."""
    marks = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(_SPAN)
    found = []
    for k, kind in enumerate(KINDS[:4]):
        pattern = F.lit(PATTERNS[kind])
        may = marks.get(kind, F.lit(True)) & text.rlike(PATTERNS[kind])
        found.append(F.when(may, F.filter(_located(text, pattern, k), partial(_checked, kind))).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*found))).otherwise(none)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{Alnum}\P{ASCII}]++")


def _term(w: Column) -> Column:
    return (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")


def _entities(kind: Column, value: Column) -> Column:
    """The value, its pool and its kind, as names of protected entities."""
    digits, name = _digits(value), kind.cast("string")
    mail = F.lower(value)
    exact = F.when(kind == 0, mail).when(kind == 1, value).otherwise(digits)
    pool = F.when(kind == 0, F.substring_index(mail, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.concat(name, F.lit(":"), exact), F.concat(name, F.lit("/"), pool), name)


def _around(text: Column, span: Column) -> Column:
    """The whole words within ``CONTEXT`` characters before and after a span, without other addresses."""
    start, stop = span["start"], span["stop"]
    begin = F.greatest(start - CONTEXT, F.lit(0))
    before, after = F.substring(text, begin + 1, start - begin), F.substring(text, stop + 1, F.lit(CONTEXT))
    before = F.when(begin > 0, F.regexp_replace(before, r"^[^\s]++", "")).otherwise(before)
    after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"[^\s]+$", "")).otherwise(after)
    return F.regexp_replace(F.concat_ws(" ", before, after), r"[^\s@]*+@[^\s]*+", " ")


def _degree(co: Column, df: Column, n_c: Column, n: int, z: float) -> tuple[Column, Column]:
    """Disclosure PMI / IC and P(c | t), both at the lower end of the Wilson interval of co in df."""
    p, zz = co / df, z * z
    low = (p + zz / (2 * df) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / df + zz / (4 * df * df))) / (1 + zz / df)
    information = F.log(F.lit(float(n)) / n_c)
    return (F.log(low) + information) / information, low


def disclosing_terms(texts: DataFrame, spans: DataFrame, support: int, disclosure: float, posterior: float = POSTERIOR, z: float = Z) -> DataFrame | None:
    """Written ``(doc_id, h)`` and ``term`` of all occurrences of disclosing terms; None if there are none.

    ``spans``: ``(doc_id, h, around, value, kind)``, one row for each base span with its context.
    """
    each = spans.select(F.xxhash64("doc_id", "h").alias("doc"), "around", F.explode(_entities(F.col("kind"), F.col("value"))).alias("c"))
    near = each.select("doc", "c", F.xxhash64("around").alias("context"), F.explode(F.array_distinct(_words(F.col("around")))).alias("term")).where(_term(F.col("term"))).distinct()
    docs_of = each.select("c", "doc").distinct().groupBy("c").agg(F.count("*").alias("n_c"))
    contexts = near.select("c", "term", "context").distinct().groupBy("c", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    both = near.select("c", "term", "doc").distinct().groupBy("c", "term").agg(F.count("*").alias("co"))
    anywhere = near.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("least"))
    n = texts.select("doc_id", "h").distinct().count()

    def discloses(df: str) -> Column:
        degree, low = _degree(F.col("co"), F.col(df), F.col("n_c"), n, z)
        return (degree >= disclosure) & (low >= posterior)

    known = contexts.join(both, ["c", "term"]).join(docs_of, "c").join(anywhere, "term").where((F.col("n_c") < n) & discloses("least"))
    known = written(known.select("term", "co", "n_c"), "terms")
    candidates = known.select("term").distinct()
    m = candidates.limit(BROADCAST + 1).count()
    if not m:
        return None
    words = texts.select("doc_id", "h", F.explode(_words(F.col("text"))).alias("term"))
    seen = written(words.join(F.broadcast(candidates) if m <= BROADCAST else candidates, "term", "left_semi").distinct(), "seen")
    df = seen.groupBy("term").agg(F.count("*").alias("df"))
    flagged = known.join(df, "term").where(discloses("df")).select("term").distinct()
    out = written(seen.join(flagged, "term", "left_semi"), "flagged")
    return out if out.head(1) else None


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Places of a text's words that are among ``terms`` (lower-cased) and not inside a base span."""
    words = _located(text, F.lit(r"[\p{Alnum}\P{ASCII}]++"), 4)
    named = F.filter(words, lambda x: F.array_contains(terms, F.lower(x["value"])))
    return F.filter(named, lambda x: ~F.exists(base, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))


def analysed(docs: DataFrame, support: int, disclosure: float) -> tuple[DataFrame, DataFrame | None]:
    """A written table ``(doc_id, h, base)`` of all rows, and ``(id, th, terms)`` of documents with disclosing terms."""
    texts = _keyed(docs)
    rows = texts.select("doc_id", "h", "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select("doc_id", "h", "base", F.transform("base", lambda s: _around(F.col("text"), s)).alias("around"))
    base = written(rows, "spans")
    each = base.where(F.size("base") > 0).select("doc_id", "h", F.explode(F.arrays_zip("base", "around")).alias("x"))
    each = each.select("doc_id", "h", F.col("x.around").alias("around"), F.col("x.base.value").alias("value"), F.col("x.base.kind").alias("kind"))
    found = disclosing_terms(texts, each, support, disclosure)
    if found is None:
        return base, None
    return base, written(found.groupBy("doc_id", "h").agg(F.collect_set("term").alias("terms")).withColumnsRenamed({"doc_id": "id", "h": "th"}), "of")


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th"))


def with_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(doc_id, h, base, terms)`` for each row of ``docs (doc_id, text)``; h identifies the text."""
    base, of = analysed(docs, support, disclosure)
    if of is None:
        return base.select("doc_id", "h", "base", F.array().cast(_SPAN).alias("terms"))
    placed = _keyed(docs).join(small(of, BROADCAST), _same())
    placed = placed.groupBy("id", "th").agg(F.first(term_spans(F.col("text"), F.col("terms"), base_spans(F.col("text")))).alias("terms"))
    return base.join(placed, _same(), "left").select("doc_id", "h", "base", F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def find_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest for each row of ``docs (doc_id, text)``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["stop"]))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return with_spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(joined(order(F.col("base"))), 256).alias("base_sha256"), joined(order(F.concat("base", "terms"))).alias("spans"),
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """All columns of ``docs``: base spans become ``[EMAIL]`` and the like, disclosing terms go; ``n_chars``, if any, is recounted."""
    _, of = analysed(docs, support, disclosure)
    whole = F.coalesce("own.text", F.lit(""))
    spans = base_spans(whole)
    rows = docs.select(F.struct(*docs.columns).alias("own"))  # one name, so that none of theirs can clash
    if of is None:
        rows = rows.select("own", spans.alias("spans"))
    else:
        met = rows.join(small(of, BROADCAST), F.col("own.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(whole) == F.col("th")), "left").select("own", "terms", spans.alias("base"))
        extra = F.when(F.col("terms").isNotNull(), term_spans(whole, F.col("terms"), F.col("base"))).otherwise(F.array().cast(_SPAN))
        rows = met.select("own", F.concat("base", extra).alias("spans"))
    labels = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "")])
    text, zero = F.col("own.text"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        # a span that begins inside an earlier one only extends what is removed
        before = F.substring(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        label = F.when(x["start"] >= a["at"], F.get(labels, x["kind"])).otherwise("")
        return F.struct(F.greatest(a["at"], x["stop"]).alias("at"), F.concat(a["out"], F.array(before, label)).alias("out"))

    done = F.aggregate(F.array_sort("spans"), zero, add)
    new = F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    rows = rows.select("own", F.when(F.size("spans") > 0, new).otherwise(text).alias("new"))
    columns = {name: F.col("own").getField(name).alias(name) for name in docs.columns}
    columns["text"] = F.col("new").alias("text")
    if "n_chars" in columns:
        kept = F.col("own.n_chars")
        columns["n_chars"] = F.when(F.col("new").eqNullSafe(text), kept).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*columns.values())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_pii": op7_pii}
