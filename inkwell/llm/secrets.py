"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

The forest learns from labelled findings: reviewed ones, or those of texts into
which secrets, and strings that only look like some, were planted. There the
label is what was planted, not a rule over the features, so a part can be held
out and precision and recall measured. DataFrame operations only: candidates,
features, training and scoring run in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import let
from .common import cut, need

#: A candidate is so long a run of key characters, at least, or a shorter value that is assigned to a credential.
LEAST_LENGTH, LEAST_ASSIGNED = 16, 8
_KEY = rf"[A-Za-z0-9+/_\-]{{{LEAST_LENGTH},}}(?:={{1,2}}(?![A-Za-z0-9+/_\-=\"'`]))?"
#: Names of credentials whose assigned values count from ``LEAST_ASSIGNED`` characters on.
_ASSIGNED = (
    r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api_?key)[\"']?\s*[=:]\s*[\"'`]?"
    rf"([^\s\"'`,;&=:]{{{LEAST_ASSIGNED},{LEAST_LENGTH - 1}}})[\"'`,;&.)}}\]>]*$"
)
#: Words, or runs of the same word, that stand near before a candidate.
NEAR = 3
#: Labelled findings that the forest is fitted to, about and at most.
SAMPLE = 20_000
TREES, DEPTH, SEED, THRESHOLD = 20, 8, 7, 0.5
#: Texts with a planted finding, and parts of them of which one is held out.
PLANTED, FOLDS = 6000, 4
#: Words that announce a credential, words of examples, and common words found inside identifiers.
CREDENTIAL = r"(?i)(token|secret|passw|api|key|auth|bearer|credential|private)"
EXAMPLE = r"(?i)(example|sample|dummy|fake|placeholder|changeme|xxxx|todo|test)"
DICTIONARY = (
    r"(?i)(the|and|for|with|from|that|this|test|user|name|file|path|data|item|list|page|home|index|image|view|class|"
    r"config|value|string|number|object|function|return|public|static|version|update|create|delete|example|sample)"
)
#: Formats that are told apart, first match first.
FORMATS = (
    ("aws_key", r"^(AKIA|ASIA)[A-Z0-9]{16}$"),
    ("vendor_token", r"^(ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_\-]{10,}$"),
    ("digits", r"^[0-9]+$"),
    ("hex", r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"),
)
FEATURES = (
    "length", "transitions", "digits", "capitals", "distinct", "dictionary", "hex", "only_digits",
    "credential_near", "credential_before", "assigned", "quoted", "example_near", "block_before", "path_example", "path_code",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(``id_col``, at, nth, candidate, kind, and :data:`FEATURES`), one row a candidate.

    ``at`` is its word's number from 0, ``nth`` its run's number in the word:
    every run of a word counts. A shorter value at a word's end that is assigned
    to a credential is one, too, with ``nth`` -1. Null and empty texts have
    none, and an empty table gives no rows. Null ids and repeated rows each give
    theirs. Texts and words of any length are read whole. Other columns are not
    read. What stands near a run is ``NEAR`` words or other runs of its word
    before it and two after it.
    """
    need(docs, id_col, text_col, *([path_col] if path_col else []))
    path = F.coalesce(F.lower(F.col(path_col).cast("string")), F.lit("")) if path_col else F.lit("")
    words = docs.select(F.col(id_col), path.alias("path"), F.split(text_col, r"[\x20\x09-\x0D]+").alias("w"))
    found = words.select(id_col, "path", "w", F.posexplode("w").alias("at", "word"))

    def near(k: int) -> Column:
        return F.coalesce(F.get("w", F.col("at") + k), F.lit(""))

    # short values end with a word that is assigned in itself or follows an assignment
    follows = F.col("word").rlike("[=:]") | near(-1).rlike("[=:][\"'`]?$") | near(-1).isin("=", ":")
    ends = F.when((F.length("word") >= LEAST_ASSIGNED) & follows, F.regexp_extract(F.concat_ws(" ", near(-2), near(-1), F.col("word")), _ASSIGNED, 1)).otherwise("")
    long = (F.length("word") >= LEAST_LENGTH) & F.col("word").rlike(_KEY)
    found = found.where((F.length("word") >= LEAST_ASSIGNED) & (long | follows)).withColumn("ends", ends).where(long | (F.col("ends") != ""))

    def runs_of(word: Column) -> Column:
        # run i stands between apart[i] and apart[i + 1]; both are found once a word
        both = F.struct(F.regexp_extract_all(word, F.lit(_KEY), 0).alias("runs"), F.split(word, _KEY, -1).alias("apart"))

        def each(b: Column) -> Column:
            def text(name: str, k: Column) -> Column:
                return F.when(k >= 0, F.coalesce(F.get(b[name], k), F.lit(""))).otherwise("")

            def run(r: Column, i: Column) -> Column:
                left = [text(name, i - k) for k in range(NEAR, 0, -1) for name in ("apart", "runs")]
                right = [text(name, i + k) for k in (1, 2) for name in ("apart", "runs")]
                return F.struct(
                    i.alias("nth"), r.alias("candidate"), F.concat(*left, text("apart", i)).alias("left"),
                    F.concat(*right, text("apart", i + 3)).alias("right"), (F.size(b["runs"]) - i).alias("to_end"),
                )

            ends = F.struct(
                F.lit(-1).alias("nth"), F.col("ends").alias("candidate"), F.regexp_extract(word, r"^(.*?[=:]|)[\"'`]?", 0).alias("left"), F.lit("").alias("right"), F.lit(1).alias("to_end"),
            )
            return F.filter(F.concat(F.transform(b["runs"], run), F.array(ends)), lambda x: x["candidate"].rlike("[A-Za-z0-9]"))

        return let(both, each)

    found = found.select(
        id_col, "path", "at", F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("words_before"),
        F.concat_ws(" ", near(1), near(2)).alias("words_after"), F.explode(runs_of(F.col("word"))).alias("r"),
    )
    # other words are near the first and the last runs only, so a long word's runs do not each carry its neighbours
    found = found.select(
        id_col, "path", "at", "r.nth", "r.candidate", "r.left", "r.right", "r.to_end",
        F.when(F.col("r.nth") < NEAR, F.col("words_before")).otherwise("").alias("before"),
        F.when(F.col("r.to_end") <= 2, F.col("words_after")).otherwise("").alias("after"),
    )
    c, size = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    kind = F.lit("generic")
    for name, pattern in reversed(FORMATS):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    around = F.concat_ws(" ", "before", F.concat("left", "candidate", "right"), "after")
    until = F.concat_ws(" ", "before", F.concat("left", "candidate", F.when(F.col("to_end") == 1, F.col("right")).otherwise("")))
    return found.withColumns({
        "kind": kind,
        "length": size.cast("double"),
        "transitions": share("[a-z](?=[0-9A-Z])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[+/_-](?=[A-Za-z0-9])"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "dictionary": (size - F.length(F.regexp_replace(c, DICTIONARY, ""))) / size,
        "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(c.rlike("^[0-9]+$")),
        "credential_near": flag(around.rlike(CREDENTIAL)),
        "credential_before": flag(until.rlike(CREDENTIAL + r"\S*\s*[=:]")),
        "assigned": flag(F.col("before").rlike(r"[=:]\W*$") | F.col("left").rlike(r"[=:]\W*$")),
        "quoted": flag(F.col("left").rlike("[\"'`]$")),
        "example_near": flag(around.rlike(EXAMPLE)),
        "block_before": flag(until.rlike(r"PRIVATE KEY-----\s*\S*$")),
        "path_example": flag(F.col("path").rlike(EXAMPLE)),
        "path_code": flag(F.col("path").rlike(r"\.(py|js|ts|java|go|rb|env|ya?ml|json|toml|ini|cfg|sh)$")),
    }).drop("path", "before", "after", "left", "right", "to_end")


#: What is planted ({k} is the finding, {w} a word), how the finding is spelled, and whether it is a secret.
PLANTS = (
    ('token = "{k}"', "hex40", 1), ("token: {k}", "hex32", 1), ("api_key={k}", "mixed32", 1), ("AWS_SECRET_ACCESS_KEY={k}", "mixed40", 1), ("Authorization: Bearer {k}", "mixed40", 1),
    ('{"user":"{w}","password":"{k}"}', "mixed18", 1), ("{k}", "vendor", 1), ("{k}", "aws", 1), ("client_secret = '{k}'", "letters24", 1), ("password = {k}", "mixed12", 1), ("passwd: '{k}'", "mixed10", 1),
    ("https://{w}.org/?id=7&auth={k}", "mixed24", 1), ("-----BEGIN RSA PRIVATE KEY----- {k}", "mixed64", 1), ("export {w}_TOKEN={k}", "vendor", 1), ("secret {w} = {k}", "hex64", 1),
    ("commit {k}", "hex40", 0), ("sha256:{k}", "hex64", 0), ("etag: \"{k}\"", "hex32", 0), ("id = {k}", "digits16", 0), ("{w} {k}", "digits16", 0), ("token {w} {k}", "digits16", 0), ("key: {k}", "digits18", 0),
    ("{k}", "path", 0), ("see {k}", "path", 0), ("{k}", "uuid", 0), ("session {k}", "uuid", 0), ("{w} {k}", "joined", 0), ("{k}", "joined", 0), ("{w}: {k}", "joined", 0), ("{k}", "name", 0), ("the key is {k}", "name", 0),
    ('token = "{k}"', "sample", 0), ("example token = {k}", "hex40", 0), ("test api_key={k}", "mixed32", 0), ("password = {k}", "changeme", 0), ("api_key: {k}", "slug", 0), ("data:image/png;base64,{k}", "mixed64", 0),
    ("{k}", "marks", 0), ("secret garden {k}", "joined", 0), ("authority {w} {k}", "joined", 0),
)
_SYLLABLES = "tion ver en ge lich and ing er ble the on re schaft men qui tra".split()


def planted_findings(spark: SparkSession, n: int = PLANTED, seed: int = SEED) -> DataFrame:
    """Candidates of ``n`` seeded texts that each hold one of :data:`PLANTS`, with ``label`` and ``held_out`` (one part of ``FOLDS``).

    Every other candidate of such a text is no secret. The same seed gives the
    same findings.
    """
    def draw(name: str, k: int | Column = 0) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(f"{seed}|{name}"), F.col("id"), F.lit(k) if isinstance(k, int) else k), 256)

    def below(most: int, name: str, k: int | Column = 0) -> Column:
        return F.pmod(F.conv(F.substring(draw(name, k), 1, 8), 16, 10).cast("long"), F.lit(most)).cast("int")

    def word(name: str, k: int | Column = 0, parts: int = 3) -> Column:
        table = F.array(*map(F.lit, _SYLLABLES))
        return F.concat(*[F.get(table, below(len(_SYLLABLES), f"{name}{p}", k)) for p in range(parts)])

    many = F.translate(F.concat(F.base64(F.unhex(draw("m"))), F.base64(F.unhex(draw("m", 1)))), "=", "Q")
    mixed = F.regexp_replace(many, "[+/]", "9")
    digits = F.concat(F.conv(F.substring(draw("n"), 1, 13), 16, 10), F.lit("4929"), F.conv(F.substring(draw("n", 1), 1, 13), 16, 10))
    h = draw("h")
    spelled = {
        "hex32": F.substring(h, 1, 32), "hex40": F.substring(h, 1, 40), "hex64": h, "vendor": F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
        "aws": F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), "letters24": F.substring(F.translate(mixed, "0123456789", "QvXtZkWpJr"), 1, 24),
        "path": F.concat_ws("/", F.lit("/usr/share"), word("p"), word("q", 0, 2), F.concat(word("r"), F.lit("2"))), "joined": word("j", 0, 7), "marks": F.repeat(F.lit("-"), 20),
        "name": F.concat_ws("_", word("p"), word("q"), word("r", 0, 2), F.lit("v2")), "slug": F.concat_ws("-", F.lit("your"), word("p"), F.lit("key"), F.lit("goes-here1")),
        "sample": F.concat(F.lit("example_"), F.substring(h, 1, 24)), "changeme": F.concat(F.lit("changeme"), F.substring(digits, 1, 4)),
        "uuid": F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
    }
    spelled |= {f"mixed{k}": F.substring(many if k >= 40 else mixed, 1, k) for k in (10, 12, 18, 24, 32, 40, 64)}
    spelled |= {f"digits{k}": F.substring(digits, 1, k) for k in (16, 18)}
    kinds = list(spelled)

    def planted(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("plant"))

    rows = spark.range(n).withColumn("plant", below(len(PLANTS), "plant")).withColumn("all", F.array(*spelled.values()))
    rows = rows.withColumns({"shown": planted([p[0] for p in PLANTS]), "how": planted([kinds.index(p[1]) for p in PLANTS]), "secret": planted([p[2] for p in PLANTS])})
    rows = rows.select("id", F.get("all", F.col("how")).alias("key"), "shown", "secret", word("w").alias("w"), *[
        F.concat_ws(" ", *[word(side, k) for k in range(5)]).alias(side) for side in ("before", "after")
    ])
    text = F.concat_ws(" ", "before", F.replace(F.replace("shown", F.lit("{w}"), F.col("w")), F.lit("{k}"), F.col("key")), "after")
    found = candidates(rows.select("id", text.alias("text")), id_col="id").join(rows.select("id", "key", "secret"), "id")
    label = ((F.col("candidate") == F.col("key")) & (F.col("secret") == 1)).cast("double")
    return found.withColumn("label", label).withColumn("held_out", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)) == 0).drop("key", "secret")


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(found)


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest for findings with ``label`` 0 or 1, or the labels' mean if they are all alike (None without any).

    About ``sample`` findings are read at most, chosen by a hash of the
    candidate; a rerun chooses the same.
    """
    need(labelled, "label", "candidate", *FEATURES)
    count, low, high, mean = labelled.agg(F.count("label"), F.min("label"), F.max("label"), F.avg("label")).first()
    if not count:
        return None
    if low == high:
        return float(mean)
    draw = F.pmod(F.xxhash64("candidate", "at"), F.lit(1_000_000)) < int(min(1.0, sample / count) * 1_000_000)
    rows = _assembled(labelled.where(draw)).select("_features", "label")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def score(found: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with ``score`` (0 to 1) and ``is_secret``. Without a model every candidate stays a secret of score 1."""
    if model is None or isinstance(model, float):
        scored = found.withColumn("score", F.lit(1.0 if model is None else model))
    else:
        scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
        scored = scored.drop("_features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Every candidate of ``docs`` with its score; nulls, repeats, empty tables and other columns are as in :func:`candidates`.

    The forest learns from ``labelled`` findings (rows of :func:`candidates`
    with ``label`` 0 or 1) or, where there are none, from those of
    :func:`planted_findings` that are not held out.
    """
    if labelled is None:
        labelled = cut(planted_findings(docs.sparkSession).where("not held_out"))
    return score(candidates(docs, id_col, text_col, path_col), fit(labelled))
