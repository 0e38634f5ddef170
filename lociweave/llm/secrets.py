"""Secret scans: candidates found in whole texts, false positives removed by a random forest.

A candidate is a run of at least LEAST characters of ``[A-Za-z0-9+/=_.-]`` that
has a digit or changes between cases; ``=`` belongs to it as padding at the end
only, a full stop at the end doesn't.  What is assigned to a name with a
credential word is a candidate too, of LEAST_ASSIGNED to MOST_ASSIGNED bytes,
with any punctuation.  Candidates may overlap.  A random forest judges each by its length
and kinds of characters, by how its characters follow each other, by how much
of it common words cover, by signs of a path, and by the words around it.  The
forest is trained from labelled findings (``findings``): texts with a span and
a label, the caller's own or, by default, those that ``example_findings`` makes
by rule from the formats of credentials and of what is taken for them.

Null and empty texts have no candidates.  Repeated rows give repeated findings.
Rows with equal texts have equal findings, so keys may repeat or be null.  An
empty table gives an empty result.  ``redact`` passes on all columns of its
input, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Texts, blocks, column_texts
from .store import BROADCAST_KEYS, having, stored

LEAST = 16
LEAST_ASSIGNED, MOST_ASSIGNED = 6, 512
CONTEXT = 48
TREES, DEPTH, SEED = 30, 8, 7
EXAMPLES = 3_600
MARK = "[SECRET]"

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_.-")] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True

# Words that stand near credentials, words that stand near what is no credential, and common words.
CREDENTIAL_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "client")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "version", "build", "order", "invoice", "card", "phone", "isbn", "file", "path", "image", "revision", "etag", "example", "placeholder", "sample", "dummy", "test")
COMMON_WORDS = ("the", "and", "for", "with", "your", "this", "that", "from", "name", "user", "data", "file", "test", "config", "default", "value", "index", "table", "page", "time", "date", "list", "item", "type", "code", "text", "line", "main", "model", "service", "manager", "handler", "request", "response", "server", "client", "example", "here", "key", "token", "secret", "password", "change", "insert", "image", "content", "version", "release", "build", "report", "final", "draft", "setting", "option", "message", "error", "number", "string", "local", "global", "public", "source", "target", "update", "create", "delete", "system", "process", "network", "window", "linux", "python", "java", "script", "style", "html", "json", "test", "unit", "case")
_COMMON = re.compile("|".join(sorted(set(COMMON_WORDS), key=lambda w: (-len(w), w))))
_WORD = re.compile(r"[A-Za-z0-9]+")
_ASSIGNED = re.compile(r"""(?:[=:]|=>)\s*["'`]?$""")
#: Credential words that count within longer names, such as dbPassword, too.
_IN_NAMES = re.compile("token|secret|passw|pwd|apikey|credential|bearer|authorization")
_PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|sk-|sk_live_|rk_live_|npm_|pypi-|hf_|SG\.|ya29\.|eyJ)")
_PLACEHOLDER = re.compile(r"^(?:[$<]|%\(|\{\{)|your|example|changeme|placeholder|insert", re.IGNORECASE)
_NAME = re.compile(rb"""([A-Za-z0-9_.-]+)\\?["'`]?\]?[ \t]*$""")
# A quoted value ends at its quote; one that isn't quoted at white space, a quote or one of ,;&<>()[]{}|
_VALUE = re.compile(rb"""[=>:]*+[ \t]*(?:(?:bearer|basic|token)[ \t]+)?(?:(\\?["'`])([^\s]{%d,%d}?)\1|[(\[{<]*([^\s"'`,;&<>()\[\]{}|]{%d,%d})(?![^\s"'`,;&<>()\[\]{}|]))""" % ((LEAST_ASSIGNED, MOST_ASSIGNED) * 2), re.IGNORECASE)
_MIXED = re.compile(rb"[0-9]|[a-z][A-Z]|[!#$%^*@~+?]")

FEATURES = ("length", "digits", "upper", "lower", "distinct", "entropy", "transitions", "repeats", "hex", "alternation", "covered", "slashes", "dots", "dashes", "after_slash", "extension", "assigned", "quoted", "credential_word", "credential_distance", "other_word", "known_prefix", "punctuation", "in_name", "placeholder")


def _rate(mask: np.ndarray) -> float:
    return float(mask.mean()) if len(mask) else 0.0


def _credential(word: str) -> bool:
    return word in CREDENTIAL_WORDS or bool(_IN_NAMES.search(word))


def describe(value: str, left: str, right: str) -> list[float]:
    """The features of a candidate with the text to its left and right."""
    b = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    kind = _DIGIT[b] * 1 + _UPPER[b] * 2 + _LOWER[b] * 3
    counts = np.bincount(b)
    p = counts[counts > 0] / len(b)
    words = [w.lower() for w in _WORD.findall(left)][-4:]
    near = [k for k, w in enumerate(reversed(words)) if _credential(w)]
    step = np.abs(np.diff(b.astype(int)))
    return [
        float(len(b)),
        _rate(_DIGIT[b]),
        _rate(_UPPER[b]),
        _rate(_LOWER[b]),
        float(len(p)) / len(b),
        float(-(p * np.log2(p)).sum()),
        _rate(kind[1:] != kind[:-1]),
        _rate(b[1:] == b[:-1]),
        _rate(np.isin(b, np.frombuffer(b"0123456789abcdef", np.uint8))),
        float(np.log1p(step).mean()) if len(step) else 0.0,
        sum(len(m) for m in _COMMON.findall(value.lower())) / len(value),
        float(value.count("/")),
        float(value.count(".")),
        float(value.count("-")),
        float(left.endswith(("/", "\\"))),
        float(bool(re.search(r"\.[a-z]{2,4}$", value))),
        float(bool(_ASSIGNED.search(left))),
        float(left[-1:] in ("'", '"', "`") and right[:1] == left[-1:]),
        float(bool(near)),
        float(near[0]) if near else 4.0,
        float(any(w in OTHER_WORDS for w in words)),
        float(bool(_PREFIX.match(value))),
        _rate(~_CANDIDATE[b]),
        float(any(_IN_NAMES.search(w) or w == "pwd" for w in words)),
        float(bool(_PLACEHOLDER.search(value))),
    ]


def _runs(inside: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs within texts."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = texts.starts[texts.starts < texts.ends]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = texts.ends[texts.starts < texts.ends] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return texts.per_text(starts)[1], starts, ends


def _assigned_spans(texts: Texts) -> list[tuple[int, int, int]]:
    """(row, start, end) of the values assigned to names with a credential word."""
    at = np.flatnonzero((texts.data == ord("=")) | (texts.data == ord(":")))
    raw = texts.data.tobytes() if len(at) else b""
    out = []
    for r, p in zip(texts.per_text(at)[1].tolist(), at.tolist(), strict=True):
        name = _NAME.search(raw[max(int(texts.starts[r]), p - CONTEXT) : p])
        if not name or not any(_credential(w.lower()) for w in _WORD.findall(name[1].decode())):
            continue
        value = _VALUE.match(raw, p + 1, int(texts.ends[r]))
        if value:
            a, z = value.span(2 if value[2] is not None else 3)
            z = a + len(raw[a:z].rstrip(b".:")) if value[2] is None else z
            if z - a >= LEAST_ASSIGNED and _MIXED.search(raw, a, z):
                out.append((r, a, z))
    return out


def candidate_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the candidates' bytes, distinct and in order."""
    data = texts.data
    inside = _CANDIDATE[data]
    equal = data == ord("=")
    row, starts, ends = _runs(equal, texts)
    parts = ends < texts.ends[row]
    parts[parts] = inside[ends[parts]]
    inside[np.flatnonzero(equal)[np.repeat(parts, ends - starts)]] = False
    row, starts, ends = _runs(inside, texts)
    ends = np.maximum(starts, np.maximum.accumulate(np.where(data != ord("."), np.arange(len(data)), -1))[ends - 1] + 1) if len(ends) else ends
    long = ends - starts >= LEAST
    row, starts, ends = row[long], starts[long], ends[long]
    total = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    turn = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[data[:-1]] & _UPPER[data[1:]], out=turn[1 : max(1, len(data))]) if len(data) > 1 else None
    good = (total[ends] > total[starts]) | (turn[ends - 1] > turn[starts])
    found = np.stack([row[good], starts[good], ends[good]], axis=1)
    assigned = _assigned_spans(texts)
    if assigned:
        found = np.unique(np.concatenate([found, np.array(assigned, np.int64)]), axis=0)
    return found[:, 0], found[:, 1], found[:, 2]


_FOUND = "row struct<a: bigint, b: bigint>, key {key}, start long, n_chars long, secret_sha256 string, features array<double>"


def row_id(text: str):
    """128 bits of a text; rows with equal texts are alike here."""
    return F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, start, n_chars, secret_sha256, features) of every candidate of every whole text; start counts code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, texts in blocks(column_texts(batch.column(2))):
                row, starts, ends = candidate_spans(texts)
                code_point = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                raw = texts.data.tobytes()
                out = []
                for r, a, z in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    value = raw[a:z].decode()
                    left = raw[max(int(texts.starts[r]), a - CONTEXT) : a].decode("utf-8", "ignore")
                    right = raw[z : min(int(texts.ends[r]), z + CONTEXT)].decode("utf-8", "ignore")
                    out.append((int(code_point[a] - code_point[texts.starts[r]]), int(code_point[z] - code_point[a]), hashlib.sha256(value.encode()).hexdigest(), describe(value, left, right)))
                at = pa.array(row + i)
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                typed = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *typed], ["row", "key", "start", "n_chars", "secret_sha256", "features"])

    schema = _FOUND.format(key=docs.schema[key].dataType.simpleString())
    return docs.select(row_id(text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def example_findings(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of n findings, made by rule: credentials in assignments, headers and prose, and their likenesses.

    The spans are those that candidate_spans finds."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lower, digits = alnum[26:52], "0123456789"
    word = lambda: pick(lower, rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))
    slug = lambda k: "-".join(pick(lower, rng.randint(3, 8)) for _ in range(k))
    known = [lambda: rng.choice(("AKIA", "ASIA")) + pick(alnum[:26] + digits, 16), lambda: f"gh{rng.choice('opsur')}_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: "xoxb-" + pick(digits, 12) + "-" + pick(alnum, 24), lambda: "glpat-" + pick(alnum + "_-", 20), lambda: "AIza" + pick(alnum + "_-", 35), lambda: "sk_live_" + pick(alnum, 24), lambda: "npm_" + pick(alnum, 36)]
    real = [lambda: pick(hexes, rng.choice((32, 40, 64))), lambda: pick(hexes, rng.choice((32, 40, 64))).upper(), lambda: pick(alnum + "+/", rng.choice((24, 40, 44))), lambda: pick(alnum + "+/", 43) + "=", *known]
    short = [lambda: pick(alnum + "!#$%^*@~+?", rng.randint(8, 20)), lambda: word() + pick(digits, rng.randint(2, 4)) + pick("!#$%*@?", rng.randint(1, 3)), lambda: pick(alnum, rng.randint(8, 15))]
    names = ("token", "secret", "password", "api_key", "access_key", "client_secret", "auth_token", "private_key", "Bearer", "API_KEY", "TOKEN", "apiKey", "DB_PASSWORD", "access_token")
    given = [lambda w: f'{w} = "', lambda w: f"{w}='", lambda w: f"{w}: ", lambda w: f"{w}=", lambda w: f'"{w}": "', lambda w: f"Authorization: {w} ", lambda w: f"export {w}=", lambda w: f"https://{word()}.com/{word()}?{w}="]
    false = [
        lambda: ("", pick(digits, 16)),
        lambda: (rng.choice(("commit ", "sha1 ", "checksum: ", "md5 = ", "revision ", "", "commit=", "?sha1=", "hash=")), pick(hexes, 40)),
        lambda: (rng.choice(("uuid ", "id: ", "", "id=", "?uuid=")), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (rng.choice(("see /", "file ", "path = /", "", "path=", "key: https://")), "/".join(word() for _ in range(3)) + pick(digits, 2) + rng.choice((".png", ".py", ".html", ""))),
        lambda: (rng.choice(("", "name=", "key=")), pick(lower, 9).capitalize() + pick(lower, 8).capitalize() + pick(lower, 5)),
        lambda: (rng.choice(('token = "', "password: ", "api_key=")), rng.choice(("your_token_here_12", "insert-your-key-here-1", "example_secret_value_00", "changeme-password-123"))),
        lambda: (rng.choice(("version ", "version=")), ".".join(pick(digits, 4) for _ in range(4))),
        lambda: (rng.choice(("order ", "order=")), "INV-" + pick(digits, 14)),
        lambda: ('integrity="', "sha384-" + pick(alnum + "+/", 64)),
        lambda: ("", "sk-" + slug(3) + pick(digits, 2)),
        lambda: (rng.choice(("key: ", "access: ", "key = ", "private: ", "client: ", "api: ")), rng.choice((word() + "ing" + pick(digits, 1), "2024-01-" + pick(digits, 2), "10.0.0." + pick(digits, 2), "Firefox/" + pick(digits, 3), "Ctrl+Shift+" + pick(digits, 1), "section" + pick(digits, 2), word() + "ably!", word() + "ingly?"))),
        lambda: (rng.choice(('password = "', "token: ", 'secret="')), rng.choice(("${DB_PASSWORD" + pick(digits, 1) + "}", "<password" + pick(digits, 3) + ">", "$SECRET_TOKEN" + pick(digits, 1), "%(password" + pick(digits, 1) + ")s"))),
        lambda: (rng.choice(("token_expiry=", "max_tokens: ", "password_timeout=")), pick(digits, rng.randint(6, 9))),
    ]
    out = []
    while len(out) < n:
        label = len(out) % 2
        before = prose()
        if not label:
            lead, value = rng.choice(false)()
        elif (kind := rng.randrange(4)) == 0:
            lead, value = rng.choice(("", "", "(", "see ", "it is ")), rng.choice(known)()
        elif kind == 1:
            lead, value = rng.choice(given[:5])(rng.choice(("password", "passwd", "pwd", "secret", "DB_PASSWORD", "token"))), rng.choice(short)()
        else:
            lead, value = rng.choice(given)(rng.choice(names)), rng.choice(real)()
        left = (before + " " if before else "") + lead
        close = left[-1] if left[-1:] in ("'", '"') else rng.choice(("", "", "", ".", ","))
        text = left + value + close + " " + prose()
        a, z = len(left), len(left) + len(value)
        spans = [(x, y) for _, x, y in zip(*(c.tolist() for c in candidate_spans(column_texts(pa.array([text])))), strict=True)]
        spans = [x for x in spans if (x == (a, z) if label else x[0] < z and a < x[1])]
        if spans:
            out.append((text, *max(spans, key=lambda x: x[1] - x[0]), label))
    return out


def train(spark: SparkSession, findings: list[tuple[str, int, int, int]] | DataFrame | None = None):
    """A RandomForestClassificationModel from labelled findings (text, start, end, label); a DataFrame's spans are code points of its text, and all its rows are learnt from, where they are."""
    from pyspark.ml.classification import RandomForestClassifier  # not at the top: Python workers don't need it
    from pyspark.ml.functions import array_to_vector

    features = lambda t, a, z: describe(t[a:z], t[max(0, a - CONTEXT) : a], t[z : z + CONTEXT])
    if isinstance(findings, DataFrame):
        rows = findings.select(F.udf(features, "array<double>")("text", "start", "end").alias("f"), F.col("label").cast("double").alias("label"))
    else:
        rows = spark.createDataFrame([(features(t, a, z), float(label)) for t, a, z, label in (findings or example_findings())], "f array<double>, label double").coalesce(1)
    data = rows.select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", findings=None) -> DataFrame:
    """(row, key, start, n_chars, secret_sha256, score, is_secret) of every candidate of every row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = train(docs.sparkSession, findings)
    found = candidates(docs, key, text).withColumn("features", array_to_vector("features"))
    judged = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return judged.select("row", F.col("key").alias(key), "start", "n_chars", "secret_sha256", "score", (F.col("score") > 0.5).cast("int").alias("is_secret"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", findings=None) -> DataFrame:
    """docs with MARK in place of each secret; n_chars, if there, follows the text."""
    spans = scan(docs, key, text, findings).filter("is_secret = 1").select("row", "start", "n_chars").distinct()
    spans = stored(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n_chars"))).alias("_spans")), "secrets")
    names = docs.columns
    # the document's own columns are in a struct, so that their names can't clash
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), row_id(text).alias("row"))
    own = [F.col("doc")[c].alias(c) for c in names]
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = batch.column(0).flatten()
            for value, cuts in zip(columns[place].to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, at = [], 0
                for c in cuts:  # in order of start; they may overlap
                    if c["start"] >= at:
                        parts += [value[at : c["start"]], MARK]
                    at = max(at, c["start"] + c["n_chars"])
                out.append("".join(parts) + value[at:])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    touched = having(numbered, spans.select("row"), "row").join(spans, "row").select("doc", "_spans").mapInArrow(run, plain.schema)
    send = F.broadcast if spans.count() <= BROADCAST_KEYS else lambda df: df
    rest = numbered.join(send(spans.select("row")), "row", "left_anti").select(*own)
    done = rest.unionByName(touched)
    return done.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done
