"""Secret scan: candidates judged by a random forest.

A candidate is a run of 12 characters and more that holds a digit, anywhere in
a word; and, of any length and characters, what is assigned to a name or
follows a word that announces a secret. Its features are its length, the mix of its characters, how likely its
character transitions are in ordinary words, how much of it dictionary words
cover, whether it looks like a path, address or number, and the words before
and after it. A forest trained on labelled findings gives the probability that
it is a secret, so false findings go.

Dictionary and transitions come from the corpus: words that occur
``MIN_COUNT`` times and more, counted over all texts. Everything runs as
DataFrame operations and Spark's own forest; no Python worker is started.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.tables import documents
from quakeloom.session import staged

MIN_COUNT = 50
MIN_LENGTH = 12
#: Labelled findings of each class that the forest may see.
PER_CLASS = 5000
TREES, DEPTH = 40, 7
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SIZE = len(ALPHABET) + 1  # and one for any other character
# Words that announce a secret, and endings of file names.
CUES = ["password", "passwd", "pwd", "pass", "token", "secret", "key", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "credentials", "access"]
CUE = rf"(?i)^\W*(?:[a-z]+[_-])*({'|'.join(CUES)})\W*$"
#: Words that stand for a sign of assignment.
SIGNS = ["=", ":", ":=", "=>", "is"]
#: A run of characters that keys and tokens are made of, with any text around it.
RUN = rf"[A-Za-z0-9+/_=.@:%~-]{{{MIN_LENGTH},}}"
NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
QUOTE = r"\\?[\"'`]"
#: name=value, name: in quotes or not; the value in double (2) or single quotes (3), or up to the word's end (4).
ASSIGNED = rf"({NAME})(?:{QUOTE})?[=:]+>?(?:\"([^\"]+)\"|'([^']+)'|[\\\"'`(\[{{<]*([^\"'`]+))"
#: Where a value without quotes ends: before the next name= of an address or list, or a closing tag.
NEXT = rf"[?&;,]+(?=(?:{QUOTE})?{NAME}(?:{QUOTE})?[=:])|</"
#: A run that begins with a name.
NAMED = rf"^({NAME})[=:]+([^=:].*)$"
OPENING, CLOSING = r"^[\"'`(\[{<]+", r"[\"'`)\]}>.,;:\\]+$"
QUOTED = r"^[(\[{<]*[\"'`]([^\"'`]+)[\"'`]"
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "hexadecimal", "transition",
    "coverage", "separators", "address", "numeric", "named", "cue_before", "cue_after", "quoted",
]


def _parts(word: Column, cued: Column) -> Column:
    """What a word holds that may be a secret: an array of (name, value), each once."""
    none = F.array().cast("array<struct<name: string, value: string>>")
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))

    def given(x: Column) -> Column:
        quoted = F.concat(F.regexp_extract(x, ASSIGNED, 2), F.regexp_extract(x, ASSIGNED, 3))
        plain = F.regexp_replace(F.regexp_extract(x, ASSIGNED, 4), CLOSING, "")
        return pair(F.regexp_extract(x, ASSIGNED, 1), F.when(quoted != "", quoted).otherwise(plain))

    # Quotes keep a value whole; without them it ends where the next name= begins.
    found = F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(0))
    pieces = F.flatten(F.transform(found, lambda x: F.when(F.regexp_extract(x, ASSIGNED, 4) == "", F.array(x)).otherwise(F.split(x, NEXT))))
    assigned = F.filter(F.transform(pieces, given), lambda x: x["value"] != "")

    def run(x: Column) -> Column:
        value = F.regexp_extract(x, NAMED, 2)
        return F.when(value != "", F.array(pair(F.regexp_extract(x, NAMED, 1), value), pair(F.lit(""), F.regexp_extract(x, NAMED, 1)))).otherwise(
            F.array(pair(F.lit(""), x))
        )

    runs = F.flatten(F.transform(F.regexp_extract_all(word, F.lit(RUN), F.lit(0)), lambda x: run(F.regexp_replace(x, "[.:]+$", ""))))
    runs = F.filter(runs, lambda x: (F.length(x["value"]) >= MIN_LENGTH) & x["value"].rlike("[0-9]"))
    opened = F.regexp_extract(word, QUOTED, 1)
    whole = F.when(opened != "", opened).otherwise(F.regexp_replace(F.regexp_replace(word, OPENING, ""), CLOSING, ""))
    follows = F.when(cued & (whole != ""), F.array(pair(F.lit(""), whole))).otherwise(none)
    known = F.array_union(assigned, F.filter(follows, lambda x: ~F.exists(assigned, lambda y: y["value"] == x["value"])))
    return F.array_union(known, F.filter(runs, lambda x: ~F.exists(known, lambda y: y["value"] == x["value"])))


def candidates(docs: DataFrame) -> DataFrame:
    """Per candidate: doc_id, place (word), value, name (what is assigned), before and after (neighbouring words)."""
    words = docs.select("doc_id", F.split("text", r"[ \t-\r]+").alias("words"))
    placed = words.select("doc_id", "words", F.posexplode_outer("words").alias("place", "word"))
    near = lambda k: F.coalesce(F.get("words", F.col("place") + k), F.lit(""))
    # The word before, skipping a lone sign of assignment.
    before = F.when(near(-1).isin(SIGNS), near(-2)).otherwise(near(-1))
    cued = before.rlike(CUE) & ~F.col("word").isin(SIGNS)
    long = (F.length("word") >= MIN_LENGTH) & F.col("word").rlike("[0-9]")
    found = placed.filter(long | F.col("word").rlike(ASSIGNED) | cued)
    return found.select(
        "doc_id", "place", "word", before.alias("before"), near(1).alias("after"),
        F.explode(_parts(F.col("word"), cued)).alias("part"),
    ).select(
        "doc_id", "place", "part.value", "part.name", "before", "after",
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"),
    )


def dictionary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of 3 to 16 letters a-z that occur often: word, n."""
    words = docs.select(F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(3, 16)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count
    )


def transitions(words: DataFrame) -> DataFrame:
    """One row: ``logs``, the log probability of each character after each other, by index in ALPHABET."""
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))")).alias("pair"))
    counts = pairs.groupBy(
        F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)).alias("a"), F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1)).alias("b")
    ).agg(F.sum("n").alias("n"))
    # At most SIZE * SIZE entries, in one row.
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct((F.col("a") * SIZE + F.col("b")).alias("k"), "n"))).alias("m"))
    return row.select(F.expr(f"""
        transform(sequence(0, {SIZE * SIZE - 1}), i -> ln((coalesce(element_at(m, i), 0L) + 1.0)
            / (aggregate(sequence(0, {SIZE - 1}), 0L, (s, j) -> s + coalesce(element_at(m, (i div {SIZE}) * {SIZE} + j), 0L)) + {SIZE}.0)))
    """).alias("logs"))


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """Per different value: the share of its characters that lie in dictionary words of 4 to 10 letters."""
    cut = values.filter(F.length("value") >= 4).select("value", F.length("value").alias("size"), F.explode(F.expr("sequence(1, length(value) - 3)")).alias("at")).select(
        "value", "size", "at", F.explode(F.expr("sequence(4, least(10, size - at + 1))")).alias("n")
    ).select("value", "size", "at", "n", F.lower(F.expr("substr(value, at, n)")).alias("word")).filter(F.col("word").rlike("^[a-z]+$"))
    # Some value may hold a hot word, but words are unique on the other side, so a skewed join can be split.
    hits = cut.join(words.select("word"), "word").groupBy("value", "size").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("n")).alias("e")))).alias("spans")
    )
    covered = F.expr("""
        aggregate(spans, struct(0 as total, 0 as upto),
            (x, p) -> struct(x.total + greatest(0, p.e - greatest(p.s, x.upto)) as total, greatest(x.upto, p.e) as upto), x -> x.total)
    """)
    return hits.select("value", (covered / F.col("size")).alias("coverage"))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with all FEATURES as doubles."""
    logs = transitions(words)
    covers = coverage(found.select("value").distinct(), words)
    index = lambda i: f"instr('{ALPHABET}', substr(lower(value), {i}, 1))"
    likely = F.expr(
        # A single character has no transition; it counts as any of SIZE.
        f"if(length(value) < 2, -ln({SIZE}.0D), aggregate(sequence(1, length(value) - 1), 0.0D, (s, i) -> s + element_at(logs, {index('i')} * {SIZE} + {index('i + 1')} + 1)) / (length(value) - 1))"
    )
    kinds = reduce(lambda x, p: F.regexp_replace(x, *p), [("[0-9]", "0"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[^0Aa]", "-")], F.col("value"))
    changes = F.expr("if(length(kinds) < 2, 0.0D, aggregate(sequence(1, length(kinds) - 1), 0, (s, i) -> s + if(substr(kinds, i, 1) <> substr(kinds, i + 1, 1), 1, 0)) / (length(kinds) - 1))")
    flag = lambda c: c.cast("double")
    return (
        found.join(covers, "value", "left").crossJoin(F.broadcast(logs))  # one row
        .withColumn("kinds", kinds)
        .select(
            "doc_id", "place", "value", "name", "before", "after",
            F.length("value").cast("double").alias("length"),
            _share("[^0-9]").alias("digits"), _share("[^A-Z]").alias("uppers"), _share("[^a-z]").alias("lowers"),
            _share("[A-Za-z0-9]").alias("others"), changes.alias("changes"),
            (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("distinct"),
            flag(F.col("value").rlike("^[0-9a-f]+$|^[0-9A-F]+$")).alias("hexadecimal"),
            likely.alias("transition"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
            _share("[^/.@:]").alias("separators"),
            flag(F.col("value").rlike(r"@|://|^www\.|^/|^~/|^\.\.?/|\.[a-z]{2,4}$")).alias("address"),
            flag(F.col("value").rlike(r"^[0-9.:+/-]+$")).alias("numeric"),
            flag(F.col("name").rlike(CUE)).alias("named"),
            flag(F.col("before").rlike(CUE)).alias("cue_before"),
            flag(F.col("after").rlike(CUE)).alias("cue_after"),
            "quoted",
        )
    )


def train(labelled: DataFrame, per_class: int = PER_CLASS) -> PipelineModel | None:
    """A forest from rows with FEATURES and ``label`` (0 or 1), ``per_class`` of each at most.

    Those with the least hash of their value are taken, and one partition holds
    them in that order, so that the forest does not depend on the cluster. None
    without rows of both classes.
    """
    order = [F.xxhash64("value", "before", "after", "name"), F.col("value"), *map(F.col, FEATURES)]
    rows = labelled.select("value", "name", "before", "after", F.col("label").cast("double").alias("label"), *FEATURES)
    sample = reduce(DataFrame.union, [rows.filter(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)])
    sample = staged(sample.coalesce(1).sortWithinPartitions(*order))
    if sample.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=9, featuresCol="features", labelCol="label")
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def judged(featured: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``probability``; without a model it is 0.5, and nothing is removed."""
    if model is None:
        return featured.withColumn("probability", F.lit(0.5))
    return model.transform(featured).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def distant_label() -> Column:
    """Labels where a form leaves no doubt, else null: known key forms and cued
    hexadecimal values (1); plain numbers, addresses and mostly words (0)."""
    value = F.col("value")
    cued = (F.col("named") + F.col("cue_before")) > 0
    return (
        F.when(value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[0-9a-zA-Z]{16,}$|^xox[abps]-[0-9A-Za-z-]{10,}$"), 1)
        .when(cued & value.rlike("^[0-9a-f]{16,}$"), 1)
        .when((F.col("numeric") == 1) | (F.col("address") == 1) | (F.col("coverage") >= 0.6), 0)
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents with its probability and verdict.

    The tables hold no labelled findings, so the query labels candidates of the
    documents with crc32(doc_id) mod 5 <> 0 by form (``distant_label``); the
    others are held out. Null and empty texts have no candidates; rows that
    repeat a doc_id are scanned one by one. The value comes as its hash only.
    """
    docs = documents(spark, sf_dir)
    words = staged(dictionary(docs))
    featured = staged(with_features(staged(candidates(docs)), words))
    labelled = featured.withColumn("label", distant_label()).filter("label is not null")
    model = train(labelled.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return judged(featured, model).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.sha2("value", 256).alias("value_sha256"),
        F.col("length").cast("int").alias("length"), "transition", "coverage", "probability",
        (F.col("probability") >= 0.5).alias("secret"),
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        distant_label().alias("label"),
    )
