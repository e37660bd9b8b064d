"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private-key blocks, values that follow a telling name, and long
tokens with a digit. Each gets figures of its length, its characters and the
changes between their kinds, the share that dictionary words cover, its path and
the words beside it. A forest trained on labelled findings gives the probability
that it is a secret.

A block is taken whole, encrypted and PGP ones too; a quoted value is taken to its
quote, an unquoted one to the next blank, quote, comma, semicolon or angle bracket.
Not looked for: blocks without their END line (their lines may be long tokens), keys
in other forms (PuTTY, SSH2 with four dashes, binary), values under six characters,
values over several lines, values after a name without one of = : := == => (as in
"password is x" or XML elements), names in other languages, and tokens without a
telling name that have under 16 characters or no digit.

Labelled findings are a parameter. ``generated_findings`` makes them by rule, half
secrets and half what scanners mistake for them, where a corpus has no labels.

Only DataFrame and JVM machine-learning operations. Places are counted in
characters from 0.

Defined results: null and empty texts have no findings; a null path has no path
figures; equal rows have findings of their own; very long texts are searched whole;
a forest's tie at the threshold is a secret; an empty table gives no rows. ``redacted``
gives all columns back, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, in_row, out_of_row, written

NAMES = r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
_KEY = r"[A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
#: To its own END line, whatever the body; never over another BEGIN. Possessive loops need no stack.
BLOCK = rf"-----BEGIN {_KEY}[^-]*+(?:-(?!----(?:BEGIN|END) {_KEY})[^-]*+)*+-----END {_KEY}"
_ASKED = rf"(?i:{NAMES})[A-Za-z0-9_]{{0,12}}[\"']?\s{{0,3}}(?:=>|[:=]{{1,2}})\s{{0,3}}"
_QUOTED = "|".join(rf"{q}(?:[^{q}\\\r\n]|\\[^\r\n]){{6,}}+(?={q})" for q in "\"'")
NAMED = rf"{_ASKED}(?:{_QUOTED}|[\"']?[^\s\"',;<>]{{6,}})"
_CHARS = "A-Za-z0-9+/_=-"
#: A name with a digit is no token: its value is wanted.
TOKEN = rf"(?<![{_CHARS}])(?=[A-Za-z+/_=-]*+[0-9])(?=[{_CHARS}]{{16}})(?![A-Za-z0-9_]{{0,40}}?{NAMED})[{_CHARS}]{{16,}}"
CANDIDATE = f"{BLOCK}|{NAMED}|{TOKEN}"
#: What every candidate contains; found much faster than one.
SIGN = "[0-9:=]|-----BEGIN"
VALUE = rf"(?s)^(?:{_ASKED}[\"']?)?(.*)$"
NEAR = 48
TREES, DEPTH, SEED, LABELLED = 40, 8, 11, 6000
THRESHOLD = 0.5

# Words that identifiers and placeholders are made of.
DICTIONARY = "account address admin alpha app archive auth base beta branch build byte change class client cluster code commit config count create data database date default delete demo dev document dummy email enable error event example factory field file filter folder format function get group handler hash header here host image index info input insert item key label level line list local log main manager map master message method model module name network node number object option order output page param password path place placeholder port primary process project property provider public query read record release remote report request response result role root sample schema secret select server service session set size source stage start state status string style system table target task temp test text time title token type update upload user util value version view web window word write your".split()

PREFIXES = ["AKIA", "ghp_", "sk-", "xoxb-", "glpat-", "AIza", "sk_live_"]
KEYS = ["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]
#: Words around secrets that no name announces: none of them tells.
UNTOLD = [w for w in DICTIONARY if w not in ("password", "secret", "token")]

FEATURES = ["log_length", "digits", "uppers", "lowers", "others", "hex", "all_digits", "changes", "distinct", "vowels", "covered", "known_prefix", "named", "quoted", "secret_near", "digest_near", "number_near", "example_near", "test_path", "code_path"]


def let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, th (hash of the text), finding (number in the text), start, end, value, before, after, path."""
    text = F.col("text").cast("string")
    rows = docs.filter(text.rlike(SIGN) & text.rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(path).cast("string").alias("path"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("text", CANDIDATE, -1).alias("rest"))
    # Where a hit starts: after all that stands between hits so far, and the hits before it.
    ends = F.aggregate(
        F.zip_with("rest", "hits", lambda r, h: F.length(r) + F.coalesce(F.length(h), F.lit(0))),
        F.array(F.lit(0)),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    found = F.transform("hits", lambda h, i: F.struct(h.alias("hit"), F.get("rest", i).alias("before"), F.get("rest", i + 1).alias("after"), i.alias("finding")))
    rows = rows.select("doc_id", "th", "path", ends.alias("ends"), found.alias("found")).select("doc_id", "th", "path", "ends", F.explode("found").alias("f"))
    value = F.when(F.col("f.hit").startswith("-----BEGIN"), F.col("f.hit")).otherwise(F.regexp_extract("f.hit", VALUE, 1))
    rows = rows.select("doc_id", "th", "path", F.col("f.finding").alias("finding"), value.alias("value"), F.get("ends", F.col("f.finding") + 1).alias("end"), "f")
    name = F.substring(F.col("f.hit"), F.lit(1), F.length("f.hit") - F.length("value"))
    return rows.select(
        "doc_id",
        "th",
        "finding",
        (F.col("end") - F.length("value")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        "value",
        F.concat(F.right("f.before", F.lit(NEAR)), name).alias("before"),
        F.left("f.after", F.lit(NEAR)).alias("after"),
        "path",
    )


def figures(found: DataFrame) -> DataFrame:
    """Adds the columns of ``FEATURES`` to rows with value, before, after, path."""
    v, before, after = F.col("value"), F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    path = F.lower(F.coalesce("path", F.lit("")))
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda kept: F.length(F.regexp_replace(v, f"[^{kept}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    yes = lambda c: c.cast("double")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    covered = 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / n
    near = F.concat_ws(" ", before, after)
    return found.withColumns({
        "log_length": F.log(n.cast("double")),
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "lowers": share("a-z"),
        "others": 1 - share("A-Za-z0-9"),
        "hex": yes(v.rlike("^[0-9a-fA-F]+$")),
        "all_digits": yes(v.rlike("^[0-9]+$")),
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),
        "vowels": F.length(F.regexp_replace(F.lower(v), "[^aeiou]", "")) / F.greatest(F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.lit(1)),
        "covered": covered,
        "known_prefix": yes(v.rlike(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ|npm_|-----BEGIN)")),
        "named": yes(before.rlike(rf"({NAMES})[a-z0-9_]{{0,12}}[\"']?\s*(=>|[:=]{{1,2}})\s*[\"']?$")),
        "quoted": yes(before.rlike("[\"']$")),
        "secret_near": yes(near.rlike(rf"({NAMES}|bearer|authorization|login)")),
        "digest_near": yes(near.rlike(r"(sha-?\d|md5|checksum|digest|commit|revision|integrity|etag|uuid|guid|fingerprint)")),
        "number_near": yes(near.rlike(r"(phone|tel|card|iban|isbn|order|invoice|serial|account no|version|timestamp)")),
        "example_near": yes(F.concat_ws(" ", near, F.lower(v)).rlike(r"(example|dummy|placeholder|sample|changeme|your[_-]|xxxx|<|\$\{|fake|todo)")),
        "test_path": yes(path.rlike("(test|mock|fixture|example|sample|doc)")),
        "code_path": yes(path.rlike(r"\.(env|ya?ml|json|py|js|ts|ini|cfg|conf|properties|tf|sh)$")),
    })


def generated_findings(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """n labelled findings made by rule: value, before, after, path, label (1: secret)."""
    row = lambda salt: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col("id").cast("string")), 512)
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (F.conv(F.substring(row(salt), 1, 7), 16, 10).cast("long") % len(of) + 1).cast("int"))
    some = lambda salt, lo, hi: (F.conv(F.substring(row(salt), 1, 7), 16, 10).cast("long") % (hi - lo + 1) + lo).cast("int")
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(row("a"), row("b")))), r"[\r\n]", "")
    alnum = F.regexp_replace(b64, "[+/=]", "q")
    hex_ = row("h")
    digits = F.translate(row("d"), "abcdef", "012345")
    word = lambda salt: pick(salt, DICTIONARY)
    prefix = pick("prefix", PREFIXES)
    sub = lambda c, size: F.substring(c, F.lit(1), size)
    uuid = F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.substring(hex_, 13, 4), F.substring(hex_, 17, 4), F.substring(hex_, 21, 12))
    lines = F.substring(F.concat_ws("\n", *(F.regexp_replace(F.base64(F.unhex(row(f"line{i}"))), r"[\r\n=]", "") for i in range(24))), F.lit(1), some("size", 16, 2000))
    secrets = [
        sub(hex_, F.lit(40)), sub(hex_, F.lit(32)), sub(hex_, some("n", 32, 64)), sub(alnum, some("n", 20, 64)), sub(b64, some("n", 24, 88)),
        F.concat(prefix, sub(alnum, some("n", 16, 40))), F.concat(word("w"), sub(F.translate(b64, "+/=", "!@#"), some("n", 6, 14))), F.concat(F.lit("eyJ"), sub(alnum, some("n", 40, 80))),
        F.concat(F.lit("-----BEGIN "), pick("key", KEYS), F.lit("-----\n"), pick("head", ["", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,5A0C\n\n", "Version: GnuPG v2\n\n"]), lines, F.lit("\n-----END "), pick("key", KEYS), F.lit("-----")),
        F.concat(prefix, sub(alnum, some("n", 16, 40))),
    ]
    others = [
        sub(hex_, F.lit(40)), sub(hex_, F.lit(64)), sub(hex_, F.lit(32)), uuid, sub(digits, F.lit(16)), sub(digits, some("n", 16, 20)),
        F.concat_ws("_", word("w"), word("x"), word("y"), some("n", 1, 99).cast("string")), F.concat(F.lit("your_"), word("w"), F.lit("_key_here_123")),
        F.concat_ws("/", word("w"), word("x"), word("y"), F.concat(word("z"), some("n", 1, 9).cast("string"))), F.concat(F.lit("xxxxxxxxxxxx"), some("n", 10, 9999).cast("string")),
        F.concat_ws("-", some("n", 1990, 2030).cast("string"), F.lit("01-15"), word("w"), word("x")),
        F.concat_ws(" ", F.lit("the"), word("w"), F.lit("of"), word("x"), F.lit("is"), word("y")),
    ]
    secret_kind = (F.conv(F.substring(row("kind"), 1, 7), 16, 10).cast("long") % len(secrets)).cast("int")
    names = ["password", "secret", "token", "api_key", "apikey", "access_key", "auth_key", "client_secret", "private_key", "API_TOKEN", "Token", "SECRET_KEY"]
    ask = F.concat(word("l"), F.lit(" "), pick("name", names), pick("op", [' = "', ": ", "=", " = '", '": "', "="]))
    bare = pick("bare", ["authorization: bearer ", "login with ", "curl -u token ", "token "])
    kind = (F.conv(F.substring(row("kind"), 1, 7), 16, 10).cast("long") % len(others)).cast("int")
    digest = pick("digest", ["sha256:", "commit ", "md5 = ", "checksum: ", "integrity sha512-", "etag ", "uuid ", "revision ", "digest "])
    number = pick("number", ["card ", "phone ", "order ", "invoice no ", "serial ", "timestamp ", ""])
    plain = F.concat(word("l"), F.lit(" "), word("m"), F.lit(" "))
    untold = F.concat_ws(" ", pick("untold1", UNTOLD), pick("untold2", UNTOLD), F.lit(""))  # key blocks and prefixed tokens in prose
    fill = F.concat(pick("name", names), pick("op", [' = "', ": ", "="]))
    other_before = F.when(kind <= 3, F.concat(word("l"), F.lit(" "), digest)).when(kind <= 5, F.concat(word("l"), F.lit(" "), number)).when(kind.isin(7, 9, 11), fill).otherwise(plain)
    rows = spark.range(0, n, 1, 4).withColumn("label", (F.col("id") % 2).cast("int"))
    paths = ["src1", "src7", "src12", "app/settings.py", "deploy/values.yaml", ".env", "web/config.json"]
    tests = ["tests/fixtures/data.json", "docs/example.md", "src3", "src0", "src15"]
    secret = F.col("label") == 1
    return rows.select(
        F.when(secret, F.element_at(F.array(*secrets), secret_kind + 1)).otherwise(F.element_at(F.array(*others), kind + 1)).alias("value"),
        F.when(secret, F.when(secret_kind >= len(secrets) - 2, untold).when(some("bare?", 0, 9) == 0, bare).otherwise(ask)).otherwise(other_before).alias("before"),
        F.concat(pick("after", ['" ', "' ", " ", "\n", '", ']), word("r")).alias("after"),
        F.when(secret | (some("path?", 0, 1) == 0), pick("path", paths)).otherwise(pick("path", tests)).alias("path"),
        "label",
    )


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """The forest, from rows with value, before, after, path and label."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(figures(labelled)).select("features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return PipelineModel([assembler, forest])


def judged(found: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and is_secret."""
    names = found.columns
    out = model.transform(figures(found))
    return out.select(*names, F.round(vector_to_array("probability")[1], 9).alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """The judged candidates of all rows of (doc_id, text, path)."""
    labelled = generated_findings(docs.sparkSession) if labelled is None else labelled
    return judged(candidates(docs, path), train(labelled))


MASK = "[SECRET]"
#: Places of secrets that may be broadcast; beyond, the join shuffles.
MOST_PLACES = 1_000_000


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``MASK`` in the places of their secrets in ``found``; all rows and columns stay."""
    places = found.filter("is_secret").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("places"))  # as many as a document has
    places = written(places, "secrets")
    size = places.agg(F.sum(F.size("places")).alias("n")).first()["n"]
    if not size:
        return docs
    places = broadcast_if_small(places) if size <= MOST_PLACES else places
    rows = in_row(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(places, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    text = F.col("row.text")
    part = lambda lo, hi: F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int"))
    masked = F.aggregate(
        "places",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, p: F.struct(F.concat(a["text"], part(a["at"], p["start"]), F.lit(MASK)).alias("text"), p["end"].alias("at")),
        lambda a: F.concat(a["text"], part(a["at"], F.length(text).cast("long"))),
    )
    return out_of_row(rows, docs.columns, text=F.when(F.col("places").isNotNull(), masked).otherwise(text))
