"""Secret scan: patterns propose candidates, a random forest trained on labelled findings removes false positives.

A candidate is a maximal run of key characters, or the value of an announced assignment, whatever its length and characters. It is described by its length, its alphabet and the transitions between kinds of characters, the share that dictionary
words cover, the path of its text and the words around it. Everything on the way from text to finding is DataFrame functions and MLlib's forest.

Training takes at most ``MAX_FINDINGS`` labelled findings, those with the smallest hashes. Where no reviewed labels exist, ``reviewed_by_rule`` labels
the candidates of half of all documents that rules can judge: documented key formats, and values known to be none. All others are left unlabelled.
"""

from __future__ import annotations

import re

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import text_of
from simloom.plans.runtime import computed_once, materialized

MAX_FINDINGS = 20_000
THRESHOLD = 0.5
CONTEXT = 48
KEY = r"[A-Za-z0-9+/_=\-]"
# Lazy text, then a whole run of at least 16 key characters or the end: every character is looked at once.
CANDIDATE = rf"(?s)(.*?)(?:(?<!{KEY})({KEY}{{16,}}+)|\z)"
# Words that make a value a placeholder, a name or a path, and words that announce a secret.
DICTIONARY = (
    "about account access address admin also and any are auth author base been but can class client code color com config content copy count data date default demo "
    "des die document domain down dummy ein email end entry error event example false file first for form from get group has have header home hook host html http "
    "image index info input item key label lang last len les license link list local log main model modul more name new next node not null number object one open "
    "option order org out page param pass path placeholder port post private public question random read request result root sample secret select self server service set "
    "site size source start state string style table tag test text that the this time title token true type und update url user value var version view was web what when "
    "which with word work world www you your"
).split()
ANNOUNCING = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|credential|private[_-]?key|auth)"
# The value of an assignment behind an announcing word: lazy text, the words before the value with its opening quote, the value; or the end.
ANNOUNCED = rf"{ANNOUNCING}(?!or)[\w-]{{0,32}}+[\"']?\s*(?:=>?|:)\s*[\"']?"
VALUE = r"((?<=\")[^\"\n]++|(?<=')[^'\n]++|(?<![\"'])[^\s\"'<>,;]++)"
VALUE_GROUP = 3 + re.compile(ANNOUNCING).groups
ASSIGNMENT = rf"(?s)(.*?)(?:({ANNOUNCED}){VALUE}|\z)"
# Formats that show by themselves what they are, and formats that other values share.
OWN_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,})$"
SHARED_FORMATS = r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]{40})$"
# Placeholders; and digits only, UUIDs, paths, and names of plain words and numbers.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|dummy|xxxx|your[_-])"
NO_SECRET = r"^([0-9]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|/?[a-z]+(/[a-z]+){2,}/?|[A-Za-z]+([_-]+([A-Za-z]+|[0-9]+))+|[-_=+/]+)$"


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, path, nth, start, candidate, before, after``: every run of key characters with a digit or mark, its place and the text around it.

    Announced and assigned values that are no such run follow them; ``nth`` counts them from the end (-1, -2, ...).
    """
    return _runs(docs, id_column, text, path).unionByName(_assigned(docs, id_column, text, path))


def _assigned(docs: DataFrame, id_column: str, text: str, path: str) -> DataFrame:
    body = text_of(text)
    read = docs.where(body.rlike(ANNOUNCED)).select(F.col(id_column).cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), body.alias("body"))
    parts = {name: F.regexp_extract_all("body", F.lit(ASSIGNMENT), k) for name, k in (("gaps", 1), ("leads", 2), ("candidates", VALUE_GROUP))}
    found = computed_once(read, "doc_id", "path", "body", **parts)
    ends = F.expr("""
        aggregate(sequence(1, size(candidates)), array(0L), (places, k) -> concat(places, array(element_at(places, -1)
                  + length(element_at(gaps, k)) + length(element_at(leads, k)) + length(element_at(candidates, k)))))""")
    placed = computed_once(found.where(F.size("candidates") > 0), "doc_id", "path", "body", "leads", "candidates", ends=ends)
    each = placed.select("doc_id", "path", "body", "ends", "leads", F.posexplode("candidates").alias("k", "candidate")).where("candidate <> ''")
    start = F.element_at("ends", F.col("k") + 2) - F.length("candidate")
    # A run of its own is a candidate already.
    run = F.col("candidate").rlike(rf"^{KEY}{{16,}}$") & F.col("candidate").rlike("[0-9+/_=]") & ~F.element_at("leads", F.col("k") + 1).rlike(rf"{KEY}$")
    return each.where(~run).select(
        "doc_id",
        "path",
        (-1 - F.col("k")).alias("nth"),
        start.alias("start"),
        "candidate",
        F.substring(F.col("body"), F.greatest(start - CONTEXT + 1, F.lit(1)).cast("int"), F.least(start, F.lit(CONTEXT)).cast("int")).alias("before"),
        F.substring(F.col("body"), (start + F.length("candidate") + 1).cast("int"), F.lit(CONTEXT)).alias("after"),
    )


def _runs(docs: DataFrame, id_column: str, text: str, path: str) -> DataFrame:
    body = text_of(text)
    # Most texts have no such run; the test also spares them the copies below.
    read = docs.where(body.rlike(rf"{KEY}{{16}}")).select(F.col(id_column).cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), body.alias("body"))
    found = computed_once(read, "doc_id", "path", "body", gaps=F.regexp_extract_all("body", F.lit(CANDIDATE), 1), runs=F.regexp_extract_all("body", F.lit(CANDIDATE), 2))
    # Where every candidate begins, from the lengths before it.
    ends = F.expr("""
        aggregate(transform(sequence(1, size(runs)), k -> length(element_at(gaps, k)) + length(element_at(runs, k))),
                  array(0L), (places, n) -> concat(places, array(element_at(places, -1) + n)))""")
    placed = computed_once(found.where(F.size("runs") > 0), "doc_id", "path", "body", "gaps", "runs", ends=ends)
    each = placed.select("doc_id", "path", "body", "ends", "gaps", F.posexplode("runs").alias("nth", "candidate"))
    start = F.element_at("ends", F.col("nth") + 1) + F.length(F.element_at("gaps", F.col("nth") + 1))
    wanted = each.where(F.col("candidate").rlike("[0-9+/_=]"))
    return wanted.select(
        "doc_id",
        "path",
        "nth",
        start.alias("start"),
        "candidate",
        F.expr(f"right(element_at(gaps, nth + 1), {CONTEXT})").alias("before"),
        F.substring(F.col("body"), (start + F.length("candidate") + 1).cast("int"), F.lit(CONTEXT)).alias("after"),
    )


def features(found: DataFrame) -> DataFrame:
    """Candidates with numbers ``f_...`` that describe them."""
    value, low = F.col("candidate"), F.lower("candidate")
    size = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    letters = F.regexp_replace(low, "[^a-z]", "")
    rest = F.regexp_replace(low, "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", "")
    covered = 1 - F.length(F.regexp_replace(rest, "[^a-z]", "")) / F.greatest(F.length(letters), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda k: F.substring(low, k, F.lit(2)))
    columns = {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": share("[0-9a-fA-F]"),
        "marks": share("[+/_=-]"),
        "vowels": share("[aeiouAEIOU]"),
        # Transitions: pairs are matched by a look ahead, so that overlapping ones count.
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "consonants": share("[b-df-hj-np-tv-z](?=[b-df-hj-np-tv-z])"),
        "repeated": share("(.)(?=\\1)"),
        "pair_variety": F.size(F.array_distinct(pairs)) / F.size(pairs),
        "dictionary": covered,
        "path_test": F.coalesce(F.col("path").rlike("(?i)(test|spec|example|sample|fixture|mock|doc)").cast("double"), F.lit(0.0)),
        "path_config": F.coalesce(F.col("path").rlike("(?i)(conf|env|secret|deploy|\\.ya?ml|\\.ini|\\.json)").cast("double"), F.lit(0.0)),
        "announced": F.col("before").rlike(ANNOUNCING).cast("double"),
        "assigned": F.col("before").rlike("(=>?|:)\\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "address": (F.col("before").rlike("(@|://|www\\.)\\S*$") | F.col("after").rlike("^(@|\\.[a-z])")).cast("double"),
        "words_before": F.regexp_count("before", F.lit("[A-Za-z]{2,}")).cast("double"),
        "words_after": F.regexp_count("after", F.lit("[A-Za-z]{2,}")).cast("double"),
    }
    return computed_once(found, *found.columns, **{f"f_{name}": column.cast("double") for name, column in columns.items()})


FEATURES = [
    f"f_{name}" for name in (
        "length digits upper lower hex marks vowels letter_digit digit_letter case_change consonants repeated pair_variety dictionary path_test path_config "
        "announced assigned quoted address words_before words_after"
    ).split()
]


def reviewed_by_rule(described: DataFrame) -> DataFrame:
    """Findings of documents of even id hash, labelled where the rule can judge them: secrets have a format of their own, or a shared one as an announced, assigned value; no
    secrets are placeholders, and numbers, UUIDs, paths and names that are not announced and assigned. The label of any other is null.
    """
    value = F.col("candidate")
    given = F.col("before").rlike(ANNOUNCING) & F.col("before").rlike("(=>?|:)\\s*[\"']?$")
    label = F.when(value.rlike(PLACEHOLDER), 0.0).when(value.rlike(OWN_FORMATS) | (value.rlike(SHARED_FORMATS) & given), 1.0).when(value.rlike(NO_SECRET) & ~given, 0.0)
    return described.where(F.xxhash64("doc_id") % 2 == 0).withColumn("label", label)


def _assembled(described: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 20, depth: int = 8) -> RandomForestRegressionModel | None:
    """Forest over at most ``max_findings`` findings with a ``label`` (0 or 1); none if they do not hold both labels.

    Half of the bound is kept for each label, so rare secrets are not crowded out. The trees average the labels of their leaves, which is the probability of a secret; a model of this
    kind keeps no training summary and with it no session, so it travels to the tasks whatever else the session has run.
    """
    known = findings.where("label IS NOT NULL").select("label", *FEATURES, F.xxhash64("candidate", "doc_id", "nth").alias("turn"))
    halves = [known.where(F.col("label") == label).orderBy("turn").limit(max_findings // 2) for label in (0.0, 1.0)]
    chosen = materialized(halves[0].unionByName(halves[1]))
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestRegressor(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(_assembled(chosen))


def scored(described: DataFrame, model: RandomForestRegressionModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Described candidates with ``probability`` and ``kept``; without a model every candidate stays, at the threshold."""
    if model is None:
        return described.withColumn("probability", F.lit(threshold)).withColumn("kept", F.lit(True))
    voted = model.transform(_assembled(described)).withColumnRenamed("prediction", "probability")
    return voted.drop("features").withColumn("kept", F.col("probability") >= threshold)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_column: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc_id, nth, start, length, fingerprint, before, probability, kept`` (the value itself stays in the text).

    ``findings`` are labelled candidates in the columns of :func:`features` plus ``label``; without them the rule labels a part of these documents. Null and empty texts have no
    candidate; rows that repeat an id are scanned each; a null path is no hint.
    """
    described = materialized(features(candidates(docs, id_column, text, path)))
    model = train(reviewed_by_rule(described) if findings is None else findings)
    return scored(described, model, threshold).select(
        "doc_id", "nth", F.col("start").cast("long").alias("start"), F.length("candidate").alias("length"),
        F.sha2(F.col("candidate"), 256).alias("fingerprint"), "before", "probability", "kept",
    )
