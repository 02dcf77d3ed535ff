"""Secret scan: candidates by pattern, false positives removed by a random forest. SQL and JVM expressions only.

A candidate is a run of key characters of ``MIN_LENGTH`` or more (and one or two ``=`` that pad it) with a digit or a
mix of cases; each comes with the words around it and the path of its document. Features: length, shares of character classes, transitions between
classes, distinct characters and entropy, longest run of letters, share covered by dictionary pieces, vowels, words
before it (secret cue, benign cue, assignment, quotes), and path hints. The forest (JVM trees, fixed seed) is trained
from labelled findings: a DataFrame of (before, candidate, after, path, label), by default a fixed number of findings
generated by rule below, so training doesn't grow with the corpus.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH = 16
TREES, MAX_DEPTH, SEED = 30, 8, 17
THRESHOLD = 0.5
#: Generated findings of each template.
PER_TEMPLATE = 120

#: Words that announce a secret, or something else of like shape.
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "credentials", "auth", "authorization", "bearer", "key")
BENIGN_CUES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "revision", "rev", "uuid", "guid", "id", "isbn", "doi", "version", "file", "path", "url", "href", "src", "card", "phone")
#: Frequent pieces of words, for dictionary coverage.
PIECES = ("the", "ing", "tion", "and", "ent", "ion", "her", "for", "tha", "nth", "int", "ere", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth", "hes", "ver", "his", "oft", "ith", "fth", "sth", "oth", "res", "ont", "der", "sch", "ein", "ich", "que", "les", "ment", "ung", "ado", "con", "test", "user", "data", "name", "page", "index", "image", "video", "main", "config", "default", "example")

#: ``=`` parts names from values; at the end of a key it is padding.
_CANDIDATE = r"[A-Za-z0-9+/_.-]"
#: What begins a run of any length; and the place in front of one.
FIND = rf"(?<!{_CANDIDATE}){_CANDIDATE}{{{MIN_LENGTH}}}"
_SPLIT = rf"(?<!{_CANDIDATE})(?={_CANDIDATE}{{{MIN_LENGTH}}})"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(before: Column, candidate: Column, after: Column, path: Column) -> dict[str, Column]:
    n = F.length(candidate).cast("double")
    low, lead = F.lower(candidate), F.lower(before)
    shape = F.translate(F.translate(F.translate(candidate, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "abcdefghijklmnopqrstuvwxyz", "a" * 26), "0123456789", "0" * 10)
    letters = F.split(candidate, "")
    distinct = F.size(F.array_distinct(letters))
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - (n - F.length(F.replace(candidate, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(candidate, c, F.lit("")))) / n))
    covered = _count(low, "|".join(sorted(PIECES, key=len, reverse=True)))
    cue = lambda words: F.regexp_like(lead, F.lit(r"(^|[^a-z0-9])(" + "|".join(words) + r")[^a-z0-9]*$")).cast("double")
    return {
        "length": n,
        "digits": _count(candidate, "[0-9]") / n,
        "uppers": _count(candidate, "[A-Z]") / n,
        "marks": _count(candidate, "[^A-Za-z0-9]") / n,
        "hexlike": F.regexp_like(low, F.lit("^[0-9a-f]+$")).cast("double"),
        "transitions": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n,
        "distinct": distinct / n,
        "entropy": entropy,
        "run": F.array_max(F.transform(F.regexp_extract_all(candidate, F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)), lambda x: F.length(x))) / n,
        "covered": covered / n,
        "vowels": _count(low, "[aeiou]") / n,
        "secret_cue": cue(SECRET_CUES),
        "benign_cue": cue(BENIGN_CUES),
        "assigned": F.regexp_like(before, F.lit(r"[=:]\s*[\"'`]?$")).cast("double"),
        "quoted": (F.regexp_like(before, F.lit("[\"'`]$")) & F.regexp_like(after, F.lit("^[\"'`]"))).cast("double"),
        "path_code": F.regexp_like(F.lower(path), F.lit(r"\.(env|ya?ml|json|toml|ini|cfg|conf|py|js|go|sh|tf)$")).cast("double"),
        "path_test": F.regexp_like(F.lower(path), F.lit(r"test|example|sample|fixture|mock|vendor|\.lock$")).cast("double"),
    }


def generated_findings(spark: SparkSession, per_template: int = PER_TEMPLATE) -> DataFrame:
    """Labelled findings by rule: templates filled from digests of row numbers. A fixed size, the same each time."""
    h = F.sha2(F.concat_ws(":", F.col("t"), F.col("id")).cast("binary"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[\r\n=]", "")
    digits = F.translate(h, "abcdef", "135790")
    up = F.translate(F.upper(h), "0123456789", "ABCDEFGHIJ")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("t", "id"), F.lit(len(words))) + 1).cast("int"))
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in PIECES]), (F.pmod(F.xxhash64("t", "id", F.lit(k)), F.lit(len(PIECES))) + 1).cast("int"))
    wordy = F.concat(*[word(k) for k in range(7)])
    size = F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(24)).cast("int")
    cut = lambda c: F.substring(c, F.lit(1), size)
    secret, benign = pick(SECRET_CUES), pick(BENIGN_CUES)
    templates = [
        (F.concat(secret, F.lit(' = "')), F.substring(h, 1, 40), F.lit('"'), 1),
        (F.concat(secret, F.lit(": '")), F.substring(h, 1, 32), F.lit("'"), 1),
        (F.concat(secret, F.lit("=")), cut(b64), F.lit(""), 1),
        (F.concat(F.lit("export "), secret, F.lit("=\"")), cut(b64), F.lit('"'), 1),
        (F.lit("use "), F.concat(F.lit("AKIA"), F.substring(F.translate(up, "F", "7"), 1, 12), F.lit("27QX")), F.lit(""), 1),
        (F.lit("with "), F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), F.lit(""), 1),
        (F.concat(F.lit("the "), secret, F.lit(" is ")), cut(b64), F.lit("."), 1),
        (F.lit("Authorization: Bearer "), F.concat_ws(".", F.substring(b64, 1, 20), F.substring(b64, 21, 30)), F.lit(""), 1),
        (F.concat(benign, F.lit(" ")), F.substring(h, 1, 40), F.lit(""), 0),
        (F.concat(benign, F.lit(": ")), F.substring(h, 1, 32), F.lit(","), 0),
        (F.concat(benign, F.lit("=")), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(""), 0),
        (F.lit("of the "), F.concat(wordy, F.substring(digits, 1, 1)), F.lit(","), 0),
        (F.lit("see "), F.concat(word(1), F.lit("/"), word(2), word(3), F.lit("/"), word(4), F.lit("-"), F.substring(digits, 1, 4), F.lit(".html")), F.lit(""), 0),
        (F.lit("call "), F.substring(digits, 1, 16), F.lit(""), 0),
        (F.lit("on "), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 4), F.substring(digits, 13, 4)), F.lit("."), 0),
        (F.lit("write to "), F.concat(word(1), word(2), F.substring(digits, 1, 2), F.lit(".mail.example.com")), F.lit(""), 0),
        (F.concat(secret, F.lit(" = \"")), F.concat(F.lit("your_"), word(1), F.lit("_"), word(2), F.lit("_here_"), F.substring(digits, 1, 1)), F.lit('"'), 0),
        (F.lit("row "), F.concat(F.repeat(F.lit("-"), 14), F.substring(digits, 1, 3), F.repeat(F.lit("="), 8)), F.lit(""), 0),
        (F.lit("at "), F.concat_ws("_", word(1), word(2), word(3), word(4), F.substring(digits, 1, 2)), F.lit(""), 0),
    ]
    paths = pick(("src1", "app/config.yaml", "tests/sample.py", "docs/page.html", "settings.env"))
    rows = [spark.range(0, per_template, 1, 1).select(F.lit(f"t{k}").alias("t"), F.col("id").cast("string").alias("id")).select(before.alias("before"), candidate.alias("candidate"), after.alias("after"), paths.alias("path"), F.lit(float(label)).alias("label")) for k, (before, candidate, after, label) in enumerate(templates)]
    return functools.reduce(DataFrame.union, rows)


def _with_features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = features(F.col("before"), F.col("candidate"), F.col("after"), F.col("path"))
    return rows.select("*", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(f"f_{k}") for k, c in cols.items()]), [f"f_{k}" for k in cols]


def train(findings: DataFrame):
    """A forest from labelled findings (before, candidate, after, path, label 0 or 1)."""
    rows, names = _with_features(findings.filter(F.col("label").isin(0.0, 1.0) & F.col("candidate").isNotNull()))
    rows = VectorAssembler(inputCols=names, outputCol="f").transform(rows.coalesce(1))
    return RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=TREES, maxDepth=MAX_DEPTH, seed=SEED).fit(rows.select("f", "label"))


def candidates(docs: DataFrame, id_col="doc_id", text_col="text", path_col: str | None = "source") -> DataFrame:
    """Every candidate: doc_id, start (code points), before, candidate, after, path.

    A text is cut in front of each candidate, so the candidate begins a piece, what stands before it ends the one
    before, and the pieces' lengths give its place.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    some = plain.filter(F.regexp_like("text", F.lit(FIND)))
    pieces = some.select("doc_id", "path", F.split("text", _SPLIT).alias("p"))
    starts = F.aggregate(F.col("p"), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    rows = pieces.select("doc_id", "path", "p", starts.alias("s")).select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.element_at("s", k).alias("start"), F.when(k > 1, F.right(F.element_at("p", F.greatest(k - 1, F.lit(1))), F.lit(80))).otherwise(F.lit("")).alias("before"), F.element_at("p", k).alias("piece"), F.when(k < F.size("p"), "A").otherwise("").alias("next")))).alias("x")).select("doc_id", "path", "x.*")
    found = rows.withColumn("candidate", F.regexp_extract(F.concat("piece", "next"), rf"^({_CANDIDATE}{{{MIN_LENGTH},}}+(?:={{1,2}}(?![A-Za-z0-9+/_.=-]))?)", 1)).filter("candidate <> ''")
    # What the next candidate begins with shows that = before it is no padding. Sentence ends aren't part of a key.
    found = found.withColumn("candidate", F.regexp_replace("candidate", r"\.+$", "")).filter(F.regexp_like("candidate", F.lit("[0-9]|[a-z][A-Z]+[a-z]")) & (F.length("candidate") >= MIN_LENGTH))
    return found.select("doc_id", "start", F.right("before", F.lit(80)).alias("before"), "candidate", F.substring(F.col("piece"), F.length("candidate") + 1, F.lit(3)).alias("after"), "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col="doc_id", text_col="text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate with the forest's verdict: doc_id, start, end, candidate_sha256, score, secret.

    Null and empty texts have no candidates. Repeated rows give their candidates each. The secret itself isn't
    returned, but its digest.
    """
    model = train(findings if findings is not None else generated_findings(docs.sparkSession))
    found, names = _with_features(candidates(docs, id_col, text_col, path_col))
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="f").transform(found))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("candidate")).cast("long").alias("end"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), score.alias("score"), (score >= threshold).alias("secret"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLE: dict[str, str] = {}
