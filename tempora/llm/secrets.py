"""Secret scans: a random forest removes the false positives among candidate strings.

A candidate is a run of 16 or more characters of the alphabets that keys are written in, a piece of that length between the slashes of
such a run, or, after a key word and a = or :, any value of ``SHORT`` characters or more. It is described by its length, its
character transitions, how much of it dictionary words cover, the path of its file and the words beside it; a random forest
trained on labelled findings gives the probability of a secret. The dictionary is the words of the whole corpus that are frequent enough to be among
the first ``DICTIONARY``; words that tie beyond that are left out together, so the order of rows plays no part.

Findings are an input: a table (value, before, after, path, label) of which the forest takes the ``FINDINGS`` first by a hash of the value; where none is given,
invented ones of the usual kinds stand in for them.

Results carry places and digests, never a candidate itself. A null or empty text has no candidate. Rows that repeat give their
findings once each; columns other than doc_id, path and text play no part. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import column, drop_staged, slices, staged, trim

DICTIONARY, LEAST, SHORT, TREES, DEPTH, FINDINGS = 20_000, 16, 6, 40, 9, 4000
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+_\-]{16,}={0,2}")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api_?key|auth|credential)\w{0,20}[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;=:<>(){}]{6,})")
_KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private")
_BENIGN_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "integrity", "digest", "uuid", "etag", "hash", "rev", "example", "sample")
_SECRET_PATH = re.compile(r"(?i)(\.env|\.pem|\.key|secret|credential|config|settings|\.ya?ml|\.ini|\.properties)")
_BENIGN_PATH = re.compile(r"(?i)(test|fixture|example|sample|mock|\.md|\.lock|vendor|node_modules|docs?/)")
FEATURES = (
    "length", "lower", "upper", "digit", "symbol", "entropy", "switches", "letter_runs", "hex", "vowels", "dictionary", "repeats",
    "key_word", "benign_word", "assigned", "quoted", "secret_path", "benign_path", "known_prefix", "distinct",
)
_PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[bpars]-|eyJ|AIza)")


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, candidate, what stands before, what stands after), by start; a run of key characters comes whole and, where slashes cut it, in pieces."""
    found = {(m.start(), m.group()) for m in _CANDIDATE.finditer(text)}
    found |= {(at + m.start(), m.group()) for at, run in list(found) if "/" in run for m in _PIECE.finditer(run)}
    found |= {(m.start(1), m.group(1)) for m in _ASSIGNED.finditer(text)}
    for at, value in sorted(found):
        yield at, value, text[max(0, at - 40) : at], text[at + len(value) : at + len(value) + 24]


def coverage(value: str, words: frozenset[str]) -> float:
    """The share of a candidate's characters that dictionary words of 4 letters or more cover, longest first from the left."""
    low, i, n = value.lower(), 0, 0
    while i < len(low):
        for l in range(min(16, len(low) - i), 3, -1):
            if low[i : i + l] in words:
                n, i = n + l, i + l
                break
        else:
            i += 1
    return n / max(len(low), 1)


def features(value: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in value]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    near = re.findall(r"[a-z_0-9]+", before.lower())[-4:] + re.findall(r"[a-z_0-9]+", after.lower())[:2]
    tail = before.rstrip(" \"'")
    return [
        float(n), kinds.count("l") / n, kinds.count("u") / n, kinds.count("d") / n, kinds.count("s") / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        max(map(len, re.findall(r"[A-Za-z]+", value)), default=0) / n, float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(c in "aeiouAEIOU" for c in value) / n, coverage(value, words), sum(a == b for a, b in zip(value, value[1:])) / n,
        float(any(k in w for w in near for k in _KEY_WORDS)), float(any(w in _BENIGN_WORDS for w in near)), float(tail[-1:] in ("=", ":")),
        float(before[-1:] in ("'", '"')), float(bool(_SECRET_PATH.search(path))), float(bool(_BENIGN_PATH.search(path))), float(bool(_PREFIX.match(value))), len(counts) / n,
    ]


def least_count(counts: DataFrame, size: int) -> int:
    """The least n for which at most `size` rows of counts (n) have that much or more; found by histograms of 1024 bins."""
    most = counts.agg(F.max("n")).first()[0]
    low, high, above = 1, (most or 0) + 1, 0  # the answer lies in low .. high; `above` rows have high or more
    while low < high:
        width = -(-(high - low) // 1024)
        bins = counts.filter(F.col("n").between(low, high - 1)).groupBy(F.floor((F.col("n") - low) / width).alias("b")).count().collect()
        for r in sorted(bins, reverse=True):
            if above + r[1] > size:
                low, high = low + r[0] * width, min(high, low + (r[0] + 1) * width)
                break
            above += r[1]
        else:
            return low
        if width == 1:
            return high
    return low


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The words of 4 to 16 letters that are frequent enough to be among the first `size` of all documents."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\p{L}{4,16}\b"), 0)).alias("w")
    counts = staged(documents.select(word).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    words = frozenset(r.w for r in counts.filter(F.col("n") >= least_count(counts, size)).select("w").collect())
    drop_staged(counts)
    return words


Finding = tuple[str, str, str, str, int]


def labelled_findings(n: int = FINDINGS, seed: int = 42) -> list[Finding]:
    """Invented findings (value, before, after, path, label) of the usual kinds, for where no reviewed ones are at hand."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    up, low, dig, hx = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    b64, mixed = up + low + dig + "+/", up + low + dig

    def word() -> str:
        return "".join(pick("bcdfghjklmnprstvwz", 1) + pick("aeiou", 1) + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def camel(k: int) -> str:
        return word() + "".join(word().capitalize() for _ in range(k))

    stems = ["api", "auth", "app", "db", "service", "client", "admin", "user", "aws", "mail"]
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "auth_token", "client_secret", "credential"]
    paths = ["src/app.py", "src/main.c", "config/settings.yaml", ".env", "data/part.txt", "web/en/1.txt", "deploy/secret.properties", "lib/client.js"]
    tame = ["tests/test_api.py", "docs/readme.md", "package.lock", "data/part.txt", "web/en/1.txt", "examples/sample.py", "src/app.py", "lib/client.js"]
    secret = [
        lambda: pick(hx, rng.choice([16, 18, 24, 32, 40, 48, 64])), lambda: pick(mixed, rng.randint(16, 48)), lambda: pick(b64, rng.choice([24, 40, 44, 64, 88])), lambda: pick(low + dig, rng.randint(16, 36)),
        lambda: "AKIA" + pick(up + "234567", 16), lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: "eyJ" + pick(b64, 60), lambda: "xoxb-" + pick(dig, 11) + "-" + pick(mixed, 24),
    ]
    short = [lambda: pick(mixed + "!#$%&*", rng.randint(8, 15)), lambda: word() + pick(dig, 2) + word() + pick("!#$", 1), lambda: word() + pick(dig, rng.randint(1, 4)) + word()]
    benign = [
        lambda: camel(rng.randint(3, 5)), lambda: "-".join(word() for _ in range(rng.randint(4, 6))), lambda: "_".join(word() for _ in range(rng.randint(4, 6))), lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(word() for _ in range(4)).upper(), lambda: "".join(word() for _ in range(5)), lambda: "".join(word() for _ in range(4)).capitalize(), lambda: pick(dig, rng.randint(16, 20)),
        lambda: "x" * rng.randint(16, 30), lambda: pick("-=_", 1) * rng.randint(16, 60), lambda: camel(2) + "V" + pick(dig, 1) + camel(2), lambda: "-".join([word(), word(), word(), "v" + pick(dig, 1)]),
    ]
    hashes = [(40, "commit "), (64, "sha256: "), (64, "sha256:"), (32, "md5 "), (40, "checksum = "), (32, "etag: \""), (40, "rev ")]
    holders = ["your_api_key_goes_here", "changeme-changeme", "replace_with_your_token", "example-password-value", "INSERT_TOKEN_HERE_PLEASE", "placeholder_secret_value"]
    weak = ["changeme", "example", "password", "required", "optional", "undefined", "disabled", "<redacted>", "********", "xxxxxxxx", "string", "process.env"]
    join = lambda: rng.choice([" = ", "=", ": ", ' = "', '="', ': "', " = '", "='"])
    out: list[Finding] = []
    for i in range(n):
        named = rng.choice(["", rng.choice(stems) + "_"]) + rng.choice(names) + join()
        if i % 2:
            value, before = (rng.choice(short)(), named) if rng.random() < 0.2 else (rng.choice(secret)(), named if rng.random() < 0.75 else rng.choice(["", "Bearer ", "key ", "with "]))
            path = rng.choice(paths)
            if before == "" and not _PREFIX.match(value):
                before = named
        else:
            kind, path = rng.random(), rng.choice(tame)
            if kind < 0.55:
                value, before = rng.choice(benign)(), rng.choice(["", "", "", word() + join(), named if rng.random() < 0.3 else ""])
            elif kind < 0.75:
                size, before = rng.choice(hashes)
                value = pick(hx, size)
            elif kind < 0.82:
                value, before = "-".join(pick(hx, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id: ", "", word() + " = "])
            elif kind < 0.9:
                value, before = rng.choice(holders), named
            else:
                value, before = (rng.choice(weak) if rng.random() < 0.6 else word() + word()), named
        quote = before[-1:] if before[-1:] in ("'", '"') else ""
        out.append((value, prose(5) + " " + before, quote + " " + prose(3), path, i % 2))
    return out


class Forest:
    """A random forest of Gini trees over numbers: bootstrap rows, a random third of the features a split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows: list[list[float]] = []
            pick = rng.integers(0, len(x), len(x))
            self._grow(x[pick], y[pick], depth, rng, rows)
            self.trees.append(np.array(rows))

    def _grow(self, x, y, depth, rng, rows) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == 0 or len(y) < 6 or y.min() == y.max():
            return at
        best = (1e18, 0, 0.0)
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, p = cut + 1.0, t[cut]
            m, q = len(y) - n, t[-1] - p
            gini = p * (1 - p / n) + q * (1 - q / m)
            i = int(gini.argmin())
            if gini[i] < best[0]:
                best = (gini[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[0] > 1e17:
            return at
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], depth - 1, rng, rows)
        b = self._grow(x[~left], y[~left], depth - 1, rng, rows)
        rows[at][:4] = [best[1], best[2], a, b]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := np.flatnonzero(t[at, 0] >= 0)).size:
                node = at[inner]
                go = x[inner, t[node, 0].astype(int)] <= t[node, 1]
                at[inner] = np.where(go, t[node, 2], t[node, 3]).astype(int)
            total += t[at, 4]
        return total / len(self.trees)


def train(findings: list[Finding], words: frozenset[str]) -> Forest:
    x = np.array([features(*f[:4], words) for f in findings])
    return Forest(x, np.array([f[4] for f in findings], float))


def findings_of(table: DataFrame, most: int = FINDINGS) -> list[Finding]:
    """At most `most` labelled findings of a table (value, before, after, path, label); those that lack a value or a label are left out."""
    rows = table.filter("value <> '' AND label IN (0, 1)").select("value", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")), F.col("label").cast("int")).distinct()
    return [tuple(r) for r in rows.orderBy(F.xxhash64("value"), "value", "before", "after", "path", "label").limit(most).collect()]


FOUND = "start int, length int, digest string, p_secret double, is_secret boolean"


def scan(files: DataFrame, forest: Forest, words: frozenset[str], threshold: float = 0.5) -> DataFrame:
    """files (doc_id, path, text) to findings (doc_id, path, start, length, digest, p_secret, is_secret); map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                at, places, x = [], [], []
                for r, (path, text) in enumerate(zip(column(b, "path").to_pylist(), column(b, "text").to_pylist())):
                    for start, value, before, after in candidates(text or ""):
                        at.append(r)
                        places.append((start, len(value), hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]))
                        x.append(features(value, before, after, path or "", words))
                if not at:
                    continue
                rows, p = pa.array(at, pa.int32()), forest.predict(np.array(x))
                start, length, digest = zip(*places)
                cols = [column(b, "doc_id").take(rows), column(b, "path").take(rows), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(digest), pa.array(p), pa.array(p >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "path", "start", "length", "digest", "p_secret", "is_secret"])
        trim()

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text").mapInArrow(run, "doc_id long, path string, " + FOUND)


def query(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Findings of all documents; a document's path is source/lang/doc_id.txt."""
    words = dictionary(documents)
    files = documents.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan(files, train(labelled_findings() if findings is None else findings_of(findings), words), words)
