"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``MIN_CHARS`` characters of the alphabets that keys are
written in, with the text before and behind it. Its features are its length, its runs of
character classes and of vowels and consonants, the share of its four-letter pieces that
the corpus's own words have (dictionary coverage), signs of a path, and the words and
marks beside it. The forest is trained from labelled findings; a finding is kept if the
forest gives it at least ``KEEP``.

The dictionary is counted over the words of all texts, and its ``WORDS`` most frequent
words give at most some 100,000 pieces, whose number is checked before they are
broadcast; more of them meet the candidates in a shuffle. Distinct candidates are looked
up once, so one that stands in a third of the rows costs as much as any other. Training
takes at most ``TRAIN_ROWS`` findings of each label, those with the smallest hashes.
Everything is DataFrame functions and JVM-side Spark ML: no Python on executors.

Defined results: null texts have no candidates; a document without one gives no row;
repeated rows give their findings again; with findings of one label only, that label is
the answer for all (score 1 or 0); without any, all are kept with a null score; a very long text is one row's work and gives
as many findings as it holds; only doc_id and text are read, so other columns may have any
name. Words of the dictionary are runs of 4 to 16 letters: shorter and longer ones cover
nothing of a candidate.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, settle

MIN_CHARS = 16
BESIDE = 48
WORDS = 20_000
PIECE = 4
BROADCAST_PIECES = 200_000
TRAIN_ROWS = 10_000
KEEP = 0.5
TREES, DEPTH = 24, 6
CANDIDATE = f"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}"
#: Words that name a credential in code and settings.
NAMES = "token|secret|passw|pwd|api_?-?key|apikey|access|auth|credential|private|bearer|signature"
MARK = "\x01"
FEATURES = (
    "length", "digits", "uppers", "lowers", "class_runs", "sound_runs", "distinct", "coverage",
    "slashes", "path_before", "assigned", "quoted", "named_before", "words_before", "words_behind", "dots",
)


def _without(column: str | Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(column, pattern, ""))


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, at, value, before, behind): ``at`` numbers the candidates of a text from 0."""
    marked = F.regexp_replace(F.translate("text", MARK, " "), f"({CANDIDATE})", f"{MARK}$1{MARK}")
    parts = documents.filter(F.col("text").rlike(CANDIDATE)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.split(marked, MARK).alias("parts")
    )
    # odd parts are candidates, even ones the text between
    beside = F.expr(
        f"transform(sequence(1, size(parts) - 2, 2), i -> named_struct("
        f"'at', int((i - 1) / 2), 'value', parts[i], 'before', right(parts[i - 1], {BESIDE}), "
        f"'behind', left(parts[i + 1], {BESIDE})))"
    )
    return parts.select("doc_id", F.inline(beside))


def dictionary(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(piece): the pieces of the most frequent words of all texts."""
    counted = documents.select(
        F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")
    ).filter(F.length("word").between(PIECE, MIN_CHARS)).groupBy("word").count()
    top = counted.orderBy(F.desc("count"), "word").limit(words)
    return top.select(F.explode(F.expr(
        f"transform(sequence(1, length(word) - {PIECE - 1}), i -> substr(word, i, {PIECE}))"
    )).alias("piece")).distinct()


def coverage(values: DataFrame, pieces: DataFrame) -> DataFrame:
    """(value, coverage) for distinct values: the share of their pieces that the dictionary has."""
    cut = values.select("value", F.explode(F.expr(
        f"transform(sequence(1, length(value) - {PIECE - 1}), i -> lower(substr(value, i, {PIECE})))"
    )).alias("piece"))
    known = pieces.withColumn("known", F.lit(1))
    if pieces.count() <= BROADCAST_PIECES:
        known = F.broadcast(known)
    return cut.join(known, "piece", "left").groupBy("value").agg(
        (F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("coverage")
    )


def features(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """The candidates and a column for each of FEATURES."""
    n = F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[0-9]+", "\x02"), "[A-Z]+", "\x03"), "[a-z]+", "\x04")
    sounds = F.regexp_replace(F.regexp_replace(
        F.lower("value"), "[aeiouy]+", "\x02"), "[a-z]+", "\x03")
    covered = settle(coverage(found.select("value").distinct(), pieces), "secret-coverage")
    measured = found.select(
        "*", n.alias("length"),
        ((n - _without("value", "[0-9]")) / n).alias("digits"),
        ((n - _without("value", "[A-Z]")) / n).alias("uppers"),
        ((n - _without("value", "[a-z]")) / n).alias("lowers"),
        (F.length(classes) / n).alias("class_runs"), (F.length(sounds) / n).alias("sound_runs"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        (n - _without("value", "/")).alias("slashes"),
        F.col("before").rlike("[/.~\\\\][A-Za-z0-9_.-]*$").alias("path_before"),
        F.col("before").rlike("[=:]\\s*[\"'`]?$").alias("assigned"),
        (F.col("before").rlike("[\"'`]$") & F.col("behind").rlike("^[\"'`]")).alias("quoted"),
        F.lower("before").rlike(f"({NAMES})[^\\p{{L}}]*$").alias("named_before"),
        F.size(F.regexp_extract_all("before", F.lit("\\p{L}{2,}"), F.lit(0))).alias("words_before"),
        F.size(F.regexp_extract_all("behind", F.lit("\\p{L}{2,}"), F.lit(0))).alias("words_behind"),
        F.col("behind").rlike("^[.,;!?]").alias("dots"),
    )
    return measured.join(covered, "value").select(
        *found.columns, *(F.col(f).cast("double").alias(f) for f in FEATURES)
    )


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | float | None:
    """A forest from (features, label) rows; the only label, or None, if there aren't two."""
    spread = F.xxhash64("value", "before", "behind")
    order = Window.partitionBy("label").orderBy(spread, "value", "before", "behind")
    few = labelled.filter(F.col("label").isNotNull()).withColumn("_at", F.row_number().over(order)).filter(
        F.col("_at") <= rows)
    # a bounded number of rows; one order makes one forest
    few = settle(few.select("label", "_at", *FEATURES).coalesce(1).sortWithinPartitions("label", "_at"), "findings")
    labels = sorted(r.label for r in few.select("label").distinct().collect())
    if len(labels) < 2:
        return float(labels[0]) if labels else None
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=17,
        minInstancesPerNode=2,
    )
    return forest.fit(_assembled(few.withColumn("label", F.col("label").cast("double"))))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judge(measured: DataFrame, model: RandomForestClassificationModel | float | None) -> DataFrame:
    """The findings with ``score``, the forest's share of votes, and ``kept``."""
    if model is None or isinstance(model, float):
        return measured.withColumn("score", F.lit(model).cast("double")).withColumn(
            "kept", F.lit(model is None or model >= KEEP))
    voted = model.transform(_assembled(measured))
    return voted.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    ).withColumn("kept", F.col("score") >= KEEP)


def scan(documents: DataFrame, labels: Column) -> DataFrame:
    """All findings of the documents, judged by a forest that learned from those with a label.

    ``labels`` is an expression over doc_id, value, before and behind: 1 for a secret, 0
    for a false positive, null for a finding that is not labelled.
    """
    prepare(documents.sparkSession)
    found = settle(candidates(documents), "secret-candidates")
    pieces = settle(dictionary(documents), "secret-pieces")
    measured = settle(features(found, pieces), "secret-features")
    return judge(measured, train(measured.withColumn("label", labels)))
