"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, table, written

#: A run of 12 or more key characters with a digit and a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])(?=[0-9+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{12,}={0,2}"
#: Characters of context on either side; documents that give the labelled findings; forest; share of trees that makes a finding.
CONTEXT, LABELLED, TREES, DEPTH, SEED, LEAST = 32, 600, 24, 8, 42, 0.5
MASK = "[SECRET]"

#: Words whose presence beside a candidate speaks for a secret, or for something else.
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key",
                "private_key", "credential", "credentials", "auth", "authorization", "bearer", "signing", "client_secret")
OTHER_WORDS = ("commit", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "integrity", "etag", "uuid", "guid", "revision",
               "rev", "hash", "isbn", "doi", "order", "invoice", "ticket", "version", "build", "image", "href", "src", "url", "path",
               "file", "card", "phone", "fixes")
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "fake", "redacted", "xxxx", "todo", "none")
#: Public prefixes of issued keys.
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abpr]-|AIza|ya29|SG|npm_|dop_v1_|hf_)"
#: Words whose letters inside a candidate count as dictionary coverage.
DICTIONARY = ("access account address admin agent align android apache archive array assets async author background backup badge "
              "banner basic batch binary block board body border bottom branch browser buffer build button cache callback camera "
              "canvas card case catalog center chain change channel chart check child class clean click client clone close cloud "
              "code color column command comment commit common compile config connect console const container content context "
              "control cookie copy core count create custom data date debug default delete demo design detail device dialog "
              "digest directory display docs document domain download draft driver dummy edit editor element email enable engine "
              "entry error event example export factory fake feature field file filter final folder font footer form format frame "
              "front function gallery game general global graph group guide handler hash head header height help history home "
              "host html http icon image import index info init input install instance integer item java join json kernel key "
              "label language large layer layout left library light line link linux list load local log login logo main manager "
              "master memory menu message meta method mobile model module mouse name network node note number object offset open "
              "option order output package page panel parent part password patch path photo picture pixel plugin point port post "
              "preview print private process product profile program project property public query queue random read record "
              "redirect release remote render report request reset resource response result return right root route sample scale "
              "schema scope screen script search secret section secure select sender server service session settings shadow "
              "shared sheet sidebar signature simple site size small source space stack start state static status storage store "
              "stream string style submit support switch system table target task team template test text theme thread thumb "
              "time title token tool total track tree type unit update upload user util value vector version video view wallet "
              "web widget width window word worker wrapper write year zone").split()
FEATURES = ("length", "digits", "uppers", "transitions", "variety", "coverage", "hexadecimal", "one_case", "prefix", "separators",
            "secret_left", "other_left", "placeholder", "assigned", "quoted", "sentence_left", "test_path", "secret_path")


def _any(text: Column, words) -> Column:
    return text.rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")(?:$|[^a-z])").cast("double")


def _features(rows: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to ``rows(cand, before, after, path)``."""
    c, left = F.col("cand"), F.lower("before")
    n = F.length(c)
    share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "coverage": (n - F.length(F.regexp_replace(F.lower(c), "(?:" + "|".join(w for w in sorted(DICTIONARY, key=len, reverse=True) if len(w) > 3) + ")", ""))) / n,
        "hexadecimal": c.rlike("^[0-9a-fA-F]+$"),
        "one_case": (F.lower(c) == c) | (F.upper(c) == c),
        "prefix": c.rlike(PREFIXES),
        "separators": share("[A-Za-z0-9]"),
        "secret_left": _any(left, SECRET_WORDS),
        "other_left": _any(left, OTHER_WORDS),
        "placeholder": _any(F.concat_ws(" ", left, F.lower("after"), F.lower(c)), PLACEHOLDERS),
        "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$"),
        "quoted": F.col("before").rlike("[\"'`]$"),
        "sentence_left": F.col("before").rlike("[A-Za-z,.]\\s$"),
        "test_path": _any(F.lower("path"), ("test", "tests", "example", "examples", "fixture", "fixtures", "mock", "docs")),
        "secret_path": _any(F.lower("path"), ("env", "secrets", "credentials", "config", "keys")),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


#: Kinds of labelled findings: 1 or 0, text before, the value (from hex digits ``h`` of a document's hash and its number ``k``), text after.
_KINDS = (
    (1, "token = \"", "substr(h, 1, 40)", "\""), (1, "password=", "substr(h, 1, 18)", ""), (1, "password: ", "substr(b, 1, 16)", ""),
    (1, "", "concat('AKIA', upper(translate(substr(b, 1, 16), '+/01', 'QZ23')))", ""), (1, "key ", "concat('AKIA', upper(translate(substr(b, 3, 16), '+/01', 'QZ23')))", ""),
    (1, "", "concat('ghp_', translate(substr(b, 1, 36), '+/', 'ab'))", ""), (1, "api_key: '", "translate(substr(b, 1, 32), '+/', 'cd')", "'"),
    (1, "secret=", "substr(b, 1, 40)", ""), (1, "Authorization: Bearer ", "translate(b, '+/', '-_')", ""), (1, "", "concat('sk-', translate(substr(b, 1, 48), '+/', 'ef'))", ""),
    (1, "client_secret = \"", "substr(h, 1, 32)", "\""), (1, "", "concat('xoxb-', substr(translate(h, 'abcdef', '012345'), 1, 12), '-', translate(substr(b, 1, 24), '+/', 'gh'))", ""),
    (0, "commit ", "substr(h, 1, 40)", ""), (0, "sha256 ", "h", ""), (0, "checksum: ", "substr(h, 1, 32)", ""), (0, "fixes ", "substr(h, 1, 12)", ""),
    (0, "", "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", ""),
    (0, "uuid=", "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", ""),
    (0, "href=\"", "concat('/images/', 2000 + k % 25, '/photo-', k, '/thumb')", "\""), (0, "", "concat('version-', k % 9, '-release-candidate')", ""),
    (0, "", "concat('user_profile_settings_', k % 100)", ""), (0, "", "concat('2024-01-', 10 + k % 20, 'T10', k % 60)", ""),
    (0, "order ", "concat('ORD-2024-', 100000 + k)", ""), (0, "password=", "concat('your-password-here', k % 10)", ""), (0, "token = \"", "concat('example-token-', k % 100)", "\""),
    (0, "api_key: '", "concat('xxxxxxxxxxxxxxxx', k % 10)", "'"), (0, "", "concat(w, k % 1000, w)", ""), (0, "see ", "concat('docs/chapter', k % 30, '/', w)", ""),
    (0, "", "concat('sha1-', substr(b, 1, 27))", ""), (0, "integrity=\"", "concat('sha512-', b)", "\""), (0, "md5 ", "substr(h, 1, 32)", ""),
)


def labelled_findings(docs: DataFrame, path: Column, most: int = LABELLED) -> DataFrame:
    """Labelled findings for training: known kinds of keys, and of strings that look like keys, set between a document's own words.

    ``most`` documents, the first in an order by hash, give one finding of each kind.
    """
    share = min(1.0, 20 * most / max(1, docs.count()))  # what is sorted is about 20 times the sample, however large the table
    rows = (docs.select("doc_id", path.alias("path"), F.coalesce(F.substring("text", 1, 200), F.lit("")).alias("t"))
            .withColumn("h", F.xxhash64("doc_id", "path")).filter(F.col("h") / float(1 << 64) + 0.5 <= share)
            .orderBy("h", "doc_id", "t").limit(most).withColumn("k", F.pmod("h", F.lit(1_000_003))).drop("h"))
    kinds = F.array(*[F.struct(F.lit(float(y)).alias("label"), F.lit(a).alias("a"), F.lit(i).alias("i"), F.lit(z).alias("z")) for i, (y, a, _, z) in enumerate(_KINDS)])
    value = F.coalesce(*[F.when(F.col("x.i") == i, F.expr(v)) for i, (_, _, v, _) in enumerate(_KINDS)])
    made = (rows.select("*", F.explode(kinds).alias("x"))
            .withColumn("h", F.sha2(F.concat_ws("/", "k", "x.i"), 256))
            .withColumn("b", F.regexp_replace(F.base64(F.unhex("h")), "[=\r\n]", ""))
            .withColumn("w", F.lower(F.regexp_extract("t", "([A-Za-z]{3,12})", 1))))
    near = F.expr("concat(substring_index(t, ' ', 1 + int(k % 4)), ' ')")
    return made.select(F.col("x.label").alias("label"), value.alias("cand"), F.right(F.concat(near, "x.a"), F.lit(CONTEXT)).alias("before"),
                       F.concat(F.col("x.z"), F.lit(" "), F.substring_index("t", " ", 2)).alias("after"), "path")


def train(docs: DataFrame, path: Column) -> PipelineModel:
    """A random forest on the labelled findings, which are one sorted partition, so that it is the same wherever it is trained."""
    found = written(labelled_findings(docs, path), "labelled")
    rows = _features(found.coalesce(1).sortWithinPartitions("label", "cand", "before"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows.select("label", *FEATURES))


def _candidates(docs: DataFrame, *kept: str) -> DataFrame:
    """A row for each candidate, and one for the text after the last: the text before it, itself and its context.

    Only texts with a candidate give rows.
    """
    parts = F.arrays_zip(F.col("gaps").alias("gap"), F.col("cands").alias("cand"), F.slice("gaps", 2, F.size("gaps")).alias("next"))
    return (docs.filter(F.col("text").rlike(CANDIDATE))
            .withColumn("gaps", F.split("text", CANDIDATE, -1)).withColumn("cands", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
            .select(*kept, F.posexplode(parts).alias("pos", "m"))
            .select(*kept, "pos", "m.gap", "m.cand", F.right("m.gap", F.lit(CONTEXT)).alias("before"), F.left("m.next", F.lit(CONTEXT)).alias("after")))


def _scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``score`` (null where there is no candidate)."""
    drop = [*FEATURES, "features", "rawPrediction", "probability", "prediction"]
    return (model.transform(_features(rows)).withColumn("score", F.when(F.col("cand").isNotNull(), vector_to_array("probability")[1])).drop(*drop))


def _path(docs: DataFrame) -> Column:
    return F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")


def secret_scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, start, length, secret, score``: the findings that stay.

    Candidates come from one pattern over the whole text; the forest sees their
    length, transitions between kinds of characters, dictionary coverage, the
    path (``source``, if there is one) and the words beside them, and drops the
    false positives.  ``start`` counts code points from 0.

    Null and empty texts have no findings, nor has an empty table (nothing is
    trained then); null ``doc_id`` and ``source`` are allowed; repeated rows give
    repeated findings.
    """
    path = _path(docs)
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, length int, secret string, score double")
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long"), path.alias("path"), "text")
    found = _candidates(rows, "number", "doc_id", "path").withColumn("glen", F.length("gap")).drop("gap")
    turn = Window.partitionBy("number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("start", (F.col("glen") + F.coalesce(F.sum(F.col("glen") + F.length("cand")).over(turn), F.lit(0))).cast("long"))
    return (_scored(placed.filter("cand IS NOT NULL"), train(docs, path)).filter(F.col("score") >= least)
            .select("doc_id", "start", F.length("cand").alias("length"), F.col("cand").alias("secret"), "score"))


def redact_secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The same rows and columns with each secret replaced by ``MASK``, and ``n_chars`` (if there is one) set to match.

    Texts without a candidate pass through as they are; only the others are
    taken apart and put together again, by row.
    """
    if docs.isEmpty():
        return docs
    number, other = fresh(docs, "row_number_", "others_")
    names = [c for c in docs.columns if c != "text"]
    rows = (docs.filter(F.col("text").rlike(CANDIDATE))
            .select(F.monotonically_increasing_id().alias(number), F.struct(*names).alias(other), _path(docs).alias("path"), "text"))
    scored = _scored(_candidates(rows, number, other, "path"), train(docs, _path(docs)))
    piece = F.concat("gap", F.when(F.col("score") >= least, F.lit(MASK)).otherwise(F.coalesce("cand", F.lit(""))))
    text = F.concat_ws("", F.transform(F.sort_array("parts"), lambda p: p["piece"]))
    whole = (scored.groupBy(number).agg(F.first(other).alias(other), F.collect_list(F.struct("pos", piece.alias("piece"))).alias("parts"))
             .withColumn("text", text))
    cols = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"{other}.{c}").alias(c) for c in docs.columns]
    return docs.filter(~F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))).unionByName(whole.select(*cols))


def op10_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
