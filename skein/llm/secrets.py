"""Secret scans: candidates by shape, a random forest against false positives.

Candidates are values of any length that stand after a key name and an assignment sign, web tokens, and, where no key
name tells of them, runs of at least ``LEAST_LENGTH`` token characters that hold a digit and a letter; ``=`` belongs to
a run as padding at its end only. Where a run is part of a longer value, both are judged, and the whole value is the
finding. The forest judges each by its length, character transitions, dictionary coverage, path, and neighbouring
words. It is trained on labelled findings: ``labelled_findings`` makes a seeded set of secrets and of look-alikes (check
sums, commit ids, identifiers, paths, placeholders, plain words) in their usual surroundings, since no table holds any;
a table of (before, value, after, label) can be passed instead.

Defined results: a null or empty text has no finding; texts of any length are scanned whole; rows that repeat an id are
scanned one by one; where secrets overlap, one finding covers them all and has the highest probability of them;
findings come without the secret, as a hash and a masked form; ``scan_secrets`` reads no other column, ``redact`` keeps
all and changes none but ``text`` and ``n_chars``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import by_size, text_bytes

LEAST_LENGTH = 16
TREES, DEPTH, LEAST_ROWS = 30, 8, 3
THRESHOLD = 0.5
CONTEXT = 48
PLACEHOLDER = b"[SECRET]"
_SLICE_BYTES, _JUDGED_AT_ONCE = 4 << 20, 4096

# Words that announce a secret, and words that announce a look-alike.
KEY_WORDS = (b"token", b"secret", b"passw", b"pwd", b"api_key", b"apikey", b"api-key", b"auth", b"bearer", b"credential", b"private_key", b"access_key", b"client_key")
OTHER_WORDS = (b"commit", b"sha", b"md5", b"checksum", b"digest", b"hash", b"uuid", b"guid", b"etag", b"revision", b"version", b"example", b"image", b"file", b"path", b"session_id", b"trace", b"build")
# Prefixes of public key formats.
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"github_pat_", b"glpat-", b"sk_live_", b"rk_live_", b"sk-", b"xoxb-", b"xoxp-", b"AIza", b"ya29.", b"eyJ", b"npm_", b"hf_")
# Common English words and name parts.
DICTIONARY = tuple(
    b"the and for with from this that have not are was you your user name file path data test main config value index table model image version "
    b"release build server client request response error message default example sample handler manager service controller module package "
    b"object string number array list item time date key token session cache local global public private static class function method return "
    b"import export node page view form button event action state store update create delete insert select order group count total start end".split()
)

_TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _TOKEN[_c] = True
_NAME = re.compile(rb"(?<![\w-])([\w-]++)[\"']?\s{0,3}(?::=|=>|={1,3}|:)\s{0,3}(?:(?i:bearer|basic|token)\s{1,3})?([\"']?)")
_VALUE = re.compile(rb"(?:[^\s\"',;<>&]|&(?![\w.-]{1,64}=))+")
_WEB_TOKEN = re.compile(rb"(?<![\w-])eyJ[\w-]{5,}+(?:\.[\w-]++){1,4}")
#: The dictionary's words in a value, longer ones first; those of three letters or fewer are in too many values.
_COVER = re.compile(b"|".join(sorted((w for w in dict.fromkeys(DICTIONARY) if len(w) > 3), key=lambda w: (-len(w), w))))
_CLASS = np.zeros(256, np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_VOWELS = frozenset(b"aeiouAEIOU")


def _runs(data: bytes) -> list[tuple[int, int]]:
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _TOKEN[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    found = []
    # A run can be short by its padding, which is no token character.
    long = edges[1::2] - edges[::2] >= LEAST_LENGTH - 2
    for start, end in zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True):
        while start < end and data[start] in b"-/+":
            start += 1
        padded = end
        while data[padded : padded + 1] == b"=":
            padded += 1
        if padded == len(data) or not _TOKEN[data[padded]]:
            end = padded
        kinds = set(_CLASS[raw[start:end]].tolist())
        if end - start >= LEAST_LENGTH and 3 in kinds and kinds & {1, 2}:
            found.append((start, end))
    return found


def _values(data: bytes) -> list[tuple[int, int]]:
    """Values after key names, and web tokens; of values inside each other the outermost and the innermost."""
    found = [m.span() for m in _WEB_TOKEN.finditer(data)] if b"eyJ" in data else []
    low = data.lower()
    if not any(w in low for w in KEY_WORDS):
        return found
    last, inner = 0, None
    for m in _NAME.finditer(data):
        name = low[m.start(1) : m.end(1)]
        if not any(w in name for w in KEY_WORDS):
            continue
        start = m.end()
        if start < last:
            inner = (start, end)
            continue
        found += [inner] if inner else []
        inner, value = None, _VALUE.match(data, start)
        if value is None:
            continue
        last = end = value.end()
        while not m[2] and end > start and (data[end - 1] in b".:`" or any(data[end - 1] == b and a not in data[start:end] for a, b in zip(b"([{", b")]}", strict=True))):
            end -= 1
        found.append((start, end))
    found += [inner] if inner else []
    return [(s, e) for s, e in found if e > s]


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Spans (start, end) of candidate secrets, in order; runs can lie inside of values."""
    return sorted({*_runs(data), *_values(data)})


def _transition_table() -> np.ndarray:
    """Log probabilities of letter pairs in the dictionary, smoothed."""
    counts = np.ones((27, 27))
    for word in DICTIONARY:
        codes = [c - 96 for c in word]
        for a, b in zip([0, *codes], [*codes, 0], strict=True):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


_TRANSITIONS = _transition_table()
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
FEATURES = 20


def features(before: bytes, value: bytes, after: bytes) -> list[float]:
    raw = np.frombuffer(value, np.uint8)
    n = max(len(raw), 1)
    kinds = _CLASS[raw]
    letters = _LETTER[raw]
    count = np.bincount(raw, minlength=256)
    share = count[count > 0] / n
    low, near = value.lower(), before.lower()
    covered = sum(map(len, _COVER.findall(low)))
    bare = low.replace(b"-", b"").replace(b"_", b"")
    hex_share = sum(c in b"0123456789abcdef" for c in bare) / max(len(bare), 1)
    last_key = max((near.rfind(w) for w in KEY_WORDS), default=-1)
    last_other = max((near.rfind(w) for w in OTHER_WORDS if not (w == b"sha" and near.rfind(w) >= 0 and not re.search(rb"\bsha(?:1|256|512)?\b", near))), default=-1)
    return [
        n, -(share * np.log2(share)).sum(), float(_TRANSITIONS[letters[:-1], letters[1:]].mean()) if n > 1 else 0.0,
        float((kinds[1:] != kinds[:-1]).sum()) / n, float((kinds == 3).mean()), float((kinds == 2).mean()), float((kinds == 0).mean()),
        hex_share, covered / n, sum(c in _VOWELS for c in value) / n, value.count(b"/"), value.count(b"-") + value.count(b"_"),
        float(before[-1:] in b"/.\\" and before != b""), float(len(share)) / min(n, 64), float(value.startswith(PREFIXES)),
        len(before) - last_key if last_key >= 0 else 99.0, len(before) - last_other if last_other >= 0 else 99.0,
        float(bool(re.search(rb"[:=]\s*[\"']?$", before))), float(before[-1:] in b"\"'" and after[:1] in b"\"'" and before != b""),
        float((raw[1:] == raw[:-1]).sum()) / n,
    ]


def labelled_findings(rows: int = 3000, seed: int = 17) -> list[tuple[bytes, bytes, bytes, int]]:
    """(before, value, after, label): a seeded half of secrets and half of look-alikes in their usual surroundings."""
    random = np.random.default_rng(seed)
    hexes, letters = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def pick(of):
        return of[int(random.integers(0, len(of)))]

    def draw(alphabet: bytes, n: int) -> bytes:
        return bytes(alphabet[k] for k in random.integers(0, len(alphabet), n))

    def filler(n: int) -> bytes:
        return b" ".join(pick(DICTIONARY) if random.random() < 0.5 else draw(b"aeiounrstlhd", int(random.integers(2, 9))) for _ in range(n))

    def close(opened: bytes) -> bytes:
        return (opened[-1:] if opened[-1:] in (b'"', b"'") else pick([b"", b" ", b"\n"])) + b" " + filler(3)

    made = []
    for k in range(rows):
        if k % 2:
            value = pick([
                lambda: draw(hexes, pick([32, 40, 40, 48, 64])), lambda: draw(letters, int(random.integers(16, 48))),
                lambda: draw(letters + b"+/", pick([20, 40, 44])), lambda: pick(PREFIXES) + draw(letters, int(random.integers(16, 40))),
                lambda: draw(letters + b"!@#$%", int(random.integers(9, 18))), lambda: draw(letters + b"!@#$%", int(random.integers(6, 10))),
            ])()
            name = pick([b"token", b"api_key", b"secret", b"SECRET_KEY", b"password", b"auth_token", b"access_key", b"client_secret", b"apikey", b"credential"])
            opened = name + pick([b" = \"", b"=\"", b" = '", b": ", b"=", b": \"", b" : '"])
            if value.startswith(PREFIXES) and random.random() < 0.4:
                opened = pick([b"", b"see ", b"\""])
            made.append((filler(3) + b" " + opened, value, close(opened), 1))
        else:
            kind = int(random.integers(0, 12))
            opened, value = [
                lambda: (pick([b"commit ", b"revision: ", b"sha256 = \"", b"md5: ", b"checksum=", b"etag: \"", b"digest = '"]), draw(hexes, pick([32, 40, 64]))),
                lambda: (pick([b"uuid ", b"id: ", b"guid = \"", b"request "]), b"-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12))),
                lambda: (pick([b"in ", b"file ", b"path: ", b"see /"]), b"/".join(pick(DICTIONARY) for _ in range(4)) + draw(b"0123456789", 2)),
                lambda: (pick([b"", b"call ", b"the "]), b"".join(pick(DICTIONARY).capitalize() for _ in range(4)) + draw(b"0123456789", int(random.integers(1, 4)))),
                lambda: (pick([b"api_key = \"", b"token: ", b"secret=\"", b"password = '"]), pick([b"your_api_key_here_123", b"xxxxxxxxxxxxxxxxxxxx1", b"changeme12345678changeme", b"example_token_0000000000", b"0000000000000000000a", b"<your-token-here>"])),
                lambda: (pick([b"url(data:image/png;base64,", b"src=\"data:image/gif;base64,"]), draw(letters + b"+/", int(random.integers(60, 200)))),
                lambda: (pick([b"", b"version ", b"build ", b"release-"]), b"-".join(draw(b"0123456789", int(random.integers(2, 6))) for _ in range(4)) + b"-" + pick(DICTIONARY)),
                lambda: (pick([b"", b"the "]), b"_".join(pick(DICTIONARY) for _ in range(int(random.integers(3, 6)))) + b"_" + draw(b"0123456789", 2)),
                lambda: (pick([b"token: ", b"password = ", b"auth=", b"secret: \"", b"api_key: "]), pick([pick(DICTIONARY), b"true", b"false", b"null", b"none", b"yes", draw(b"aeiounrstlhd", int(random.integers(1, 9)))])),
                lambda: (pick([b"tokens: ", b"max_tokens = ", b"auth_count=", b"password_length: "]), draw(b"0123456789", int(random.integers(1, 6)))),
                lambda: (pick([b"token = ", b"password: ", b"secret=", b"auth = "]), pick([b"get_%s()", b"self.%s", b"os.environ[%s]", b"${%s}", b"<%s>", b"{{%s}}"]) % pick(DICTIONARY)),
                lambda: (pick([b"auth ", b"token ", b"password "]), b"-".join(pick(DICTIONARY) for _ in range(4)) + b"-" + draw(b"0123456789", 1)),
            ][kind]()
            made.append((filler(3) + b" " + opened, value, close(opened), 0))
    return made


class Forest:
    """Gini trees on bootstrap rows; each split looks at a random few of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 29):
        random = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = random.integers(0, len(y), len(y))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rows], y[rows], 0, nodes, random)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, random: np.random.Generator) -> int:
        at = len(nodes)
        nodes.append((0, 0.0, -1, -1, float((y.sum() + 0.5) / (len(y) + 1))))
        if depth < DEPTH and 0 < y.sum() < len(y) and len(y) >= 2 * LEAST_ROWS:
            best = (1e-9, 0, 0.0)
            whole = y.mean() * (1 - y.mean())
            for f in random.permutation(x.shape[1])[: 1 + int(np.sqrt(x.shape[1]))]:
                order = np.argsort(x[:, f], kind="stable")
                value, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
                gain = whole - (n * left * (1 - left) + (len(y) - n) * right * (1 - right)) / len(y)
                gain[(value[1:] == value[:-1]) | (n < LEAST_ROWS) | (len(y) - n < LEAST_ROWS)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(f), float((value[k] + value[k + 1]) / 2))
            if best[0] > 1e-9:
                low = x[:, best[1]] <= best[2]
                children = self._grow(x[low], y[low], depth + 1, nodes, random), self._grow(x[~low], y[~low], depth + 1, nodes, random)
                nodes[at] = (best[1], best[2], *children, nodes[at][4])
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = left[node] >= 0
                node = np.where(inner, np.where(x[rows, feature[node]] <= cut[node], left[node], right[node]), node)
            total += value[node]
        return total / TREES


@functools.lru_cache(maxsize=1)
def default_forest() -> Forest:
    rows = labelled_findings()
    return Forest(np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float))


def find(data: bytes, forest: Forest) -> list[tuple[int, int, float]]:
    """Spans of the secrets of one text, in order and without overlap, with their probability."""
    spans = candidates(data)
    if not spans:
        return []
    judged: dict[tuple[int, int], float] = {}
    for start in range(0, len(spans), _JUDGED_AT_ONCE):
        part = spans[start : start + _JUDGED_AT_ONCE]
        x = np.array([features(data[max(0, s - CONTEXT) : s], data[s:e], data[e : e + CONTEXT]) for s, e in part])
        judged.update(zip(part, forest.probability(x).tolist(), strict=True))
    whole: dict[int, int] = {}
    for s, e in spans:
        whole[s] = max(e, whole.get(s, 0))
    # A value that begins with a secret is one to its end; of secrets inside each other the outermost stays.
    merged: dict[tuple[int, int], float] = {}
    for (s, e), p in judged.items():
        if p >= THRESHOLD:
            merged[s, whole[s]] = max(p, merged.get((s, whole[s]), 0.0))
    found: list[tuple[int, int, float]] = []
    for (s, e), p in sorted(merged.items()):
        if found and s < found[-1][1]:
            found[-1] = (found[-1][0], max(e, found[-1][1]), max(p, found[-1][2]))
        else:
            found.append((s, e, p))
    return found


def kind_of(value: bytes) -> str:
    if value.startswith(PREFIXES):
        return "prefixed"
    return "hex" if re.fullmatch(rb"[0-9a-fA-F]+", value) else "base64" if re.fullmatch(rb"[A-Za-z0-9+/_=-]+", value) else "assigned"


def scan_secrets(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """One row per finding: doc_id, start_byte, n_bytes, kind, masked, secret_sha256, probability."""
    forest = forest or default_forest()
    schema = "doc_id long, start_byte long, n_bytes long, kind string, masked string, secret_sha256 string, probability double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text_bytes(text.as_py())
                for s, e, p in find(data, forest):
                    value = data[s:e]
                    shown = min(4, (e - s) // 4)
                    masked = value[:shown].decode("utf-8", "replace") + "*" * (e - s - shown)
                    rows.append((doc_id.as_py(), s, e - s, kind_of(value), masked, hashlib.sha256(value).hexdigest(), round(p, 6)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``docs`` with every secret replaced by a placeholder; ``n_chars``, where there is one, counts the new text."""
    forest = forest or default_forest()
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def clean(text: str | None) -> str | None:
        data = text_bytes(text)
        for s, e, _ in reversed(find(data, forest)):
            data = data[:s] + PLACEHOLDER + data[e:]
        return None if text is None else data.decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, at, _SLICE_BYTES):
                columns, old = list(part.columns), part.column(at).to_pylist()
                new = [clean(t) for t in old]
                columns[at] = pa.array(new, part.schema.types[at])
                if counted >= 0:
                    sizes = [len(b) if b is not None and b != a else n for a, b, n in zip(old, new, columns[counted].to_pylist(), strict=True)]
                    columns[counted] = pa.array(sizes, part.schema.types[counted])
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
