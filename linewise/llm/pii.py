"""Personal data: base patterns, and terms that tell which protected value a text holds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import with_free_names
from linewise.session import materialize

# The base patterns, for Java. Where a pattern would try every start in a run of like characters, it here
# tries the start of the run (or the end of the last match) only, and runs are taken whole: a try that fails there
# fails everywhere in the run, so the matches are the same and the time stays in proportion to the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What any text with a match of the kind holds; others are not searched.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}
KINDS = [*PATTERNS, "term"]
#: Positions are summed up in blocks of so many pieces.
BLOCK = 64
#: Characters on either side of a value that count as its context.
CONTEXT = 80
#: What a term consists of, what parts terms, and the characters that a term has at least.
INNER = r"[\p{L}\p{Nd}]"
TERM = r"[^\p{L}\p{Nd}]+"
TERM_LENGTH = 3

SPAN = "struct<kind: int, start: bigint, end: bigint, value: string>"


def _bind(value: Column, then) -> Column:
    """`then` of `value`, worked out once: a lambda's body works out anew whatever is not a lambda's variable."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(values: Column, fold) -> Column:
    """`fold` over the values before each place (0 where there are none), in two levels, so that the work is about the
    number of values times BLOCK."""

    def each(v: Column, ahead: Column) -> Column:
        within = lambda i: F.slice(v, i - i % BLOCK + 1, i % BLOCK)
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.struct(F.get(ahead, F.floor(i / BLOCK).cast("int")).alias("a"), fold(within(i)).alias("b")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))

    def ahead(block: Column) -> Column:
        return F.transform(block, lambda _, b: fold(F.slice(block, 1, b)))

    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    some = lambda v: _bind(blocks(v), lambda block: _bind(ahead(block), lambda x: each(v, x)))
    return _bind(values, lambda v: F.when(F.size(v) > 0, some(v)).otherwise(none))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _most(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0).cast("bigint"))


def _spans(text: Column, pattern: Column, kind: int) -> Column:
    """All leftmost, non-overlapping matches with their places in code points."""
    def place(sizes: Column) -> Column:
        before = _running(F.transform(sizes, lambda x: x["p"] + x["n"]), _sum)
        return F.zip_with(sizes, before, lambda x, y: F.struct(
            F.lit(kind).alias("kind"), (y["a"] + y["b"] + x["p"]).alias("start"), (y["a"] + y["b"] + x["p"] + x["n"]).alias("end"), x["m"].alias("value")))

    # a piece of text before each match, and one after the last
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1), lambda m, p: F.struct(
        F.length(p).cast("bigint").alias("p"), m.alias("m"), F.length(m).cast("bigint").alias("n")))
    return _bind(F.filter(pairs, lambda x: x["m"].isNotNull()), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
                          lambda d, i: d.cast("bigint") * (i % 2 + 1) - F.when((i % 2 == 1) & (d >= "5"), 9).otherwise(0))
    return _sum(doubled) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\.", -1), _small),
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Valid base matches by kind as listed, then start."""
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        hint = text.contains(HINTS[kind]) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
        valid = VALID[kind]
        spans = F.filter(_spans(text, F.lit(pattern), i), lambda x: valid(x["value"]))  # noqa: B023
        found.append(F.when(hint, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*found)


def _text_key() -> Column:
    return F.md5("text")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), TERM, -1), lambda x: F.length(x) >= TERM_LENGTH))


def _value(span: Column) -> Column:
    """A span's value as it is counted: the kind, then the address in lower case, or digits without what parts them."""
    parts = F.transform(F.split(span["value"], r"\.", -1), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    same = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, F.concat_ws(".", parts)).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), same)


def _held_values(docs: DataFrame) -> DataFrame:
    """(key, value, copies, context): the protected values of each distinct text, the number of its rows, and a hash of what
    stands within CONTEXT characters of the value."""
    side = lambda start, n: F.substring("text", start, n)
    context = lambda x: F.concat(
        F.regexp_replace(side(F.greatest(F.lit(1), x["start"].cast("int") + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"].cast("int"))), f"^{INNER}+", ""),
        F.lit(" "), F.regexp_replace(side(x["end"].cast("int") + 1, F.lit(CONTEXT)), f"{INNER}+$", ""))
    spans = docs.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    near = spans.select(_text_key().alias("key"), F.explode(F.transform("spans", lambda x: F.struct(
        _value(x).alias("value"), x["start"].alias("start"), F.xxhash64(context(x)).alias("context")))).alias("x")).select("key", "x.*")
    # equal documents have equal rows: one of them, with their number, goes on
    near = near.groupBy("key", "value", "start", "context").agg(F.count("*").alias("copies"))
    return near.groupBy("key", "value").agg(F.max("copies").alias("copies"), F.min("context").alias("context"))


def _held_words(docs: DataFrame) -> DataFrame:
    """(key, term, place, origin): the terms of each distinct text outside its values, a hash of the two words on either side
    of the term, and the text's least hash of three words in a row, which near copies mostly share."""
    spans = docs.withColumn("spans", base_spans(F.col("text")))
    rest = _replaced(spans, lambda _: F.lit(" ")).select("key", F.filter(F.split(F.lower("text"), TERM, -1), lambda x: x != "").alias("words"))
    around = F.transform("words", lambda x, i: F.struct(x.alias("term"), F.xxhash64(*[F.coalesce(F.get("words", i + d), F.lit("")) for d in (-2, -1, 1, 2)]).alias("place")))
    origin = F.array_min(F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))))
    rows = rest.select("key", origin.alias("origin"), F.explode(around).alias("x")).select("key", "origin", "x.*")
    return rows.where(F.length("term") >= TERM_LENGTH).groupBy("key", "term").agg(F.min("place").alias("place"), F.min("origin").alias("origin"))


def _documents_with(docs: DataFrame, terms: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, documents): how many rows of `docs` hold each of the distinct `terms` (a written table).

    Up to `most` terms reach every task, so that only their rows are counted; beyond it, all words are counted before they
    meet the terms: a task sends each of its words once, however common."""
    held = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    few = terms.count() <= most
    counted = (held.join(F.broadcast(terms), "term") if few else held).groupBy("term").agg(F.count("*").alias("documents"))
    return counted if few else counted.join(terms, "term")


def revealing_terms(docs: DataFrame, support: int = 3, likelihood: float = 0.5, bits: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(terms, texts): the terms that disclose a protected value, and for each text that holds any (by its md5) which.

    A term is a run of three or more letters and digits, anywhere in a document. Values that differ in case, spaces or
    leading zeros only are one. A term discloses value v if at least the share `likelihood` of the documents with the term
    hold v, and if that makes v at least 2**bits times as likely as in the whole corpus. Copies are no evidence: among
    the distinct texts that hold both there must be `support` different surroundings of the value and of the term, and
    `support` different origins (least hash of three words in a row), which make at least half of the texts: near copies
    mostly share theirs. Counts cover all documents.

    Values that are too rare or too common to be disclosed by any term are left out first, and so is a term beside a value
    if too many documents hold the term; where no value is left, no text is read again.
    """
    spark, total = docs.sparkSession, docs.count()
    values = materialize(_held_values(docs), "pii-values")
    often = values.groupBy("value").agg(F.sum("copies").alias("times"), F.count_distinct("context").alias("contexts"))
    often = materialize(often.where((F.col("contexts") >= support) & (F.col("times") * 2.0**bits <= total)).select("value", "times"), "pii-often")
    if often.isEmpty():
        none = spark.range(0)
        return none.select(F.lit("").alias("term")), none.select(F.lit("").alias("key"), F.array(F.lit("")).alias("terms"))
    asked = materialize(values.join(often, "value"), "pii-asked")
    keys = materialize(asked.select("key").distinct(), "pii-keys")
    words = materialize(_held_words(docs.select(_text_key().alias("key"), "text").join(keys, "key", "left_semi")), "pii-words")
    candidates = materialize(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term"), "pii-candidates")
    counted = words.join(_documents_with(docs, candidates), "term")
    # together <= times, so a pair beyond this bound can't reach the likelihood
    both = counted.join(asked, "key").where(F.col("documents") * likelihood <= F.col("times"))
    judged = both.groupBy("value", "term", "times", "documents").agg(
        F.sum("copies").alias("together"), F.count("*").alias("texts"), F.count_distinct("context").alias("contexts"),
        F.count_distinct("place").alias("places"), F.count_distinct("origin").alias("origins"))
    given = F.col("together") / F.col("documents")
    apart = (F.least("contexts", "places", "origins") >= support) & (2 * F.col("origins") >= F.col("texts"))
    terms = judged.where(apart & (given >= likelihood) & (F.log2(given * total / F.col("times")) >= bits)).select("term").distinct()
    terms = materialize(terms, "pii-revealing")
    held = docs.select(_text_key().alias("key"), F.explode(_words(F.col("text"))).alias("term")).join(terms, "term")
    texts = held.groupBy("key").agg(F.collect_set("term").alias("terms"))
    return terms, materialize(texts, "pii-texts")


def find_private(docs: DataFrame, **thresholds) -> DataFrame:
    """Adds `spans` to `docs`: array of (kind, start, end, value), kind an index into KINDS, by kind, then start.

    Base patterns first, then every occurrence of a disclosing term (revealing_terms, given `thresholds`) that touches
    no base span. Places count code points, end exclusive. A NULL text has no spans, like an empty one. Repeated rows
    get the same spans; an empty table gives none. Texts of any length are searched whole. A column of `docs` named spans,
    in any case, is replaced; ones named key or terms stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    return with_free_names(docs, {"key", "terms"}, lambda rows: _marked(rows, thresholds))


def _marked(docs: DataFrame, thresholds: dict) -> DataFrame:
    _, texts = revealing_terms(docs, **thresholds)
    marked = docs.withColumn("key", _text_key()).join(texts, "key", "left").drop("key")
    # the longest first, so that no term is cut short by one it begins with; terms hold letters and digits only
    either = F.array_join(F.reverse(F.array_sort(F.col("terms"))), "|")
    pattern = F.concat(F.lit(f"(?iu)(?<!{INNER})(?:"), either, F.lit(f")(?!{INNER})"))
    base = marked.withColumn("spans", F.coalesce(base_spans(F.col("text")), F.array().cast(f"array<{SPAN}>")))
    free = F.filter(_spans(F.col("text"), pattern, len(PATTERNS)), lambda x: ~F.exists("spans", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return base.withColumn("spans", F.when(F.col("terms").isNotNull(), F.concat("spans", free)).otherwise(F.col("spans"))).drop("terms")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans as text."""
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] < len(PATTERNS))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)],
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, labels: dict[str, str] | None = None, **thresholds) -> DataFrame:
    """`docs` with each stretch covered by spans generalised to the label of its first span, or removed (label "");
    n_chars, if there, is counted anew. Texts without spans, NULL ones too, and all other columns stay as they are."""
    return with_free_names(docs, {"key", "terms", "spans"}, lambda rows: _mask(rows, labels, thresholds))


def _replaced(found: DataFrame, label) -> DataFrame:
    """`found` (text, spans) with each stretch covered by spans replaced by `label` of its first span's kind."""
    found = found.withColumn("spans", F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])))
    reach = _running(F.transform("spans", lambda x: x["end"]), _most)
    found = found.withColumn("spans", F.when(F.size("spans") > 0, F.zip_with("spans", reach, lambda x, y: F.struct(
        x["kind"].alias("kind"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), F.greatest(y["a"], y["b"]).cast("int").alias("reach")))))
    parts = F.transform("spans", lambda x: F.when(x["start"] >= x["reach"], F.concat(F.substring("text", x["reach"] + 1, x["start"] - x["reach"]), label(x["kind"]))).otherwise(""))
    end = F.array_max(F.transform("spans", lambda x: x["end"]))
    masked = F.concat(F.array_join(parts, ""), F.substring("text", end + 1, F.length("text")))
    return found.withColumn("text", F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("text")))


def _mask(docs: DataFrame, labels: dict[str, str] | None, thresholds: dict) -> DataFrame:
    labels = {kind: f"[{kind.upper()}]" for kind in KINDS} | (labels or {})
    names, label = docs.columns, F.array(*[F.lit(labels[k]) for k in KINDS])
    found = _replaced(find_private(docs, **thresholds), lambda kind: F.get(label, kind))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*names)
