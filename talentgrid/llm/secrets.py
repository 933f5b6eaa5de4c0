"""Secret scanning: wide candidate patterns, then a random forest that removes false positives.

Candidates are long runs of key characters, whatever stands behind ``=``, ``:`` or ``=>``, the words
beside a word like password or token, and passwords in URLs. They may overlap. For each, features describe its length, its character transitions (classes and surprise under
the bigrams of ordinary words), how much of it dictionary words cover, whether it is part of a path,
and what its neighbouring words say. Trees are grown on bootstrap samples of labelled findings, with
a random choice of features at each split.

Offsets count characters of the whole text. Null and empty texts have no candidates.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import hashes, slices, trim

#: A value may hold any characters but spaces; a quoted one ends with its quote, others also where the next field of JSON or of a query starts.
VALUE = re.compile(
    r"""(?:=>|[=:])\s{0,3}(?:"(?P<double>[^"\s]{4,})"|'(?P<single>[^'\s]{4,})'|["']?(?!//|[=>"'])(?P<bare>(?:(?!["'][,}\]]|,["'{\[]|&\w+=)\S){4,}))"""
)
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
LOGIN = re.compile(r"://[^\s/:@]*:(?P<value>[^\s/\"'<>]+)@")
#: Neighbouring words that speak for and against a secret (fixed values).
FOR = ("password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "auth", "bearer", "credential", "credentials", "access", "private")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "etag", "revision", "rev", "version", "isbn", "phone", "image", "file", "path", "url")
WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
SECRET_WORD = re.compile(r"(?<![A-Za-z])(?:api_?keys?|(?:" + "|".join(FOR) + r")s?)(?![A-Za-z])", re.I)
TOKEN = re.compile(r"\S+")
#: Words before and after a secret word that are candidates, and what is cut off at the ends of a word.
BEFORE, AFTER = 2, 3
OPEN, CLOSE = "\"'`([{<", "\"'`)]}>.,;:"
#: How far neighbouring words are looked for, in characters.
NEAR = 48
TREES, DEPTH, LEAF = 40, 9, 4
THRESHOLD = 0.5
#: Labelled findings that the forest is grown on (a documented bound of the fit).
TRAIN_FINDINGS = 6000
#: Words of the corpus in the sentences of generated findings (a documented bound of the fit).
SENTENCE_WORDS = 20_000
FEATURES = (
    "length", "digits", "upper", "lower", "other", "changes", "entropy", "surprise", "covered", "hex", "slashes", "dashes", "path",
    "assigned", "quoted", "login", "symbols", "placeholder", "for", "against", "nearest_for", "nearest_against", "key_prefix", "numeric", "uuid",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate of a text, in order; they may overlap."""
    out = {m.span("value") for m in LOGIN.finditer(text)}
    logins = {a for a, _ in out}
    at = 0
    while m := VALUE.search(text, at):
        a, b = m.span(m.lastgroup)
        inner = SECRET_WORD.search(text, a, b)  # such a value may hold an assignment to it
        at = inner.end() if inner else b
        if a not in logins:
            out.add((a, a + len(text[a:b].rstrip(CLOSE))) if m["bare"] else (a, b))
    out |= {m.span() for m in RUN.finditer(text)}
    tokens: list[tuple[int, int]] = []
    for m in SECRET_WORD.finditer(text):
        tokens = tokens or [t.span() for t in TOKEN.finditer(text)]
        k = bisect.bisect_right(tokens, (m.start(), len(text))) - 1
        for a, b in tokens[max(0, k - BEFORE) : k + 1 + AFTER]:
            inside = a <= m.start() < b
            word = text[a:b]
            if word[0] in "\"'" and word[0] in word[1:]:
                word = word[: word.index(word[0], 1)]
                b = a + len(word)
            a, b = a + len(word) - len(word.lstrip(OPEN)), b - len(word) + len(word.rstrip(CLOSE))
            if not inside:
                out.add((a, b))
    return sorted(c for c in out if c[1] - c[0] >= 4 or c[0] in logins)


class Lexicon:
    """Words as a Bloom filter of ``parts`` times 2**BITS bits, a part for each CAPACITY of them, and the numbers of their 27 x 27 bigrams."""

    BITS, PROBES = 26, 4

    def __init__(self, words: Iterable[str] = (), parts: int = 1):
        self.filter = np.zeros(parts << self.BITS - 6, np.uint64)
        self.bigrams = np.zeros(27 * 27, np.int64)
        self.add(pa.array([w for w in dict.fromkeys(words) if len(w) >= 4], pa.string()))

    @classmethod
    def places(cls, words: pa.Array, size: int) -> np.ndarray:
        """The places of each word in a filter of ``size`` bits, a row for each probe."""
        h = hashes(words)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(size) for k in range(cls.PROBES)])

    def bits(self, words: pa.Array) -> np.ndarray:
        return self.places(words, 64 * len(self.filter))

    @staticmethod
    def pairs(words: pa.Array) -> np.ndarray:
        """The numbers of the bigrams of words."""
        out = np.zeros(27 * 27, np.int64)
        for w in words.to_pylist():
            for a, b in zip(w, w[1:]):
                if "a" <= a <= "z" and "a" <= b <= "z":
                    out[(ord(a) - 97) * 27 + ord(b) - 97] += 1
        return out

    def add(self, words: pa.Array) -> None:
        at = self.bits(words).ravel()
        np.bitwise_or.at(self.filter, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.bigrams += self.pairs(words)

    def has(self, words: pa.Array) -> np.ndarray:
        at = self.bits(words)
        return ((self.filter[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)


class Describer:
    """Features of candidates; knows the bigrams and words of ordinary text."""

    #: Places of a candidate that are looked up at once.
    BLOCK = 4096

    def __init__(self, words: Iterable[str] | Lexicon):
        self.words = words if isinstance(words, Lexicon) else Lexicon(words)
        n = self.words.bigrams.reshape(27, 27) + 1.0
        self.surprise = -np.log2(n / n.sum(1, keepdims=True))

    def covered(self, s: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        low, at, got = s.lower(), 0, 0
        for first in range(0, len(low), self.BLOCK):
            spans = [(k, n) for k in range(first, min(first + self.BLOCK, len(low))) for n in range(min(14, len(low) - k), 3, -1)]
            known = self.words.has(pa.array([low[k : k + n] for k, n in spans], pa.string()))
            longest = dict(reversed([spans[x] for x in np.flatnonzero(known)]))
            while at < min(first + self.BLOCK, len(low)):
                n = longest.get(at, 0)
                got, at = got + n, at + max(1, n)
        return got / len(s)

    def features(self, text: str, a: int, b: int) -> list[float]:
        s = text[a:b]
        n = len(s)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
        share = {k: kinds.count(k) / n for k in "dulo"}
        counts = np.unique(list(s), return_counts=True)[1] / n
        low = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in s.lower()]
        before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
        lead = [w.lower() for w in WORD.findall(before)][-4:][::-1]
        trail = [w.lower() for w in WORD.findall(after)][:2]
        first = lambda own: next((1 / (k + 1) for k, w in enumerate(lead) if w in own), 0.0)
        tight = before.rstrip(" \"'")
        return [
            n, share["d"], share["u"], share["l"], share["o"],
            sum(x != y for x, y in zip(kinds, kinds[1:])) / max(1, n - 1),
            float(-(counts * np.log2(counts)).sum()),
            float(np.mean([self.surprise[x, y] for x, y in zip(low, low[1:])])) if n > 1 else 0.0,
            self.covered(s),
            float(all(c in "0123456789abcdefABCDEF" for c in s)),
            s.count("/"), s.count("-") + s.count("_"),
            float(before[-1:] in tuple("/.\\@") or after[:1] in tuple("/@\\") or "://" in before[-12:]),
            float(tight[-1:] in ("=", ":") or tight[-2:] == "=>"),
            float(before[-1:] in ('"', "'")),
            float(after[:1] == "@" and bool(re.search(r"://[^\s/:@]*:$", before))),
            sum(not c.isalnum() and c not in "+/_-" for c in s) / n,
            float(s[:1] in "<$%{[" and s[-1:] in ">%}])"),
            float(any(w in FOR for w in lead + trail)), float(any(w in AGAINST for w in lead + trail)),
            first(FOR), first(AGAINST),
            float(bool(re.match(r"AKIA[0-9A-Z]{12,}|gh[pousr]_|sk[-_]|xox[bp]-|AIza|eyJ", s))),
            float(s.isdigit()),
            float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        ]


# ---------------------------------------------------------------- labelled findings
def labelled_findings(words: list[str], n: int = TRAIN_FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): all candidates of n sentences of the given words, half of which hold a secret. What reviewers of scans
    see again and again is generated from its format: keys, tokens and passwords against digests, ids, numbers, paths and names."""
    dice = random.Random(seed)
    hexes = lambda k: "".join(dice.choices("0123456789abcdef", k=k))
    mixed = lambda k, more="": "".join(dice.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more, k=k))
    upper = lambda k: "".join(dice.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=k))
    digits = lambda k: "".join(dice.choices("0123456789", k=k))
    word = lambda: dice.choice(words) if words else "word"
    join = lambda: dice.choice((" = ", "=", ": ", ":", " ", ' = "', '="', ': "', "='"))
    name = lambda own: dice.choice((own, own.upper(), f"{word()}_{own}", f"my {own}", own.capitalize()))
    leet = lambda w: "".join({"a": "@", "o": "0", "s": "$", "e": "3", "i": "1"}.get(c, c) if dice.random() < 0.6 else c for c in w)
    marks = lambda k: "".join(dice.choices("!@#$%^&*.?-_~+", k=k))
    human = lambda: dice.choice((
        lambda: leet(word()).capitalize() + marks(1) + digits(dice.choice((2, 4))),
        lambda: leet(word()) + "-" + digits(2) + marks(1) + mixed(1),
        lambda: ".".join((word(), word(), digits(1) + word())),
        lambda: dice.choice(".!+#*").join((word(), dice.choice((word(), digits(1))), dice.choice((digits(1) + word(), word() + digits(1))))),
        lambda: mixed(dice.randint(3, 8)) + marks(1) + mixed(dice.randint(3, 8), "!@#$%^&*"),
        lambda: word() + digits(1) + "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") + digits(1) for _ in range(dice.randint(2, 4))),
    ))()
    mail = lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.com"
    secret = [
        lambda: (name(dice.choice(("password", "passwd", "pwd", "secret"))) + dice.choice((join(), " => ", "=")), human()),
        lambda: (name(dice.choice(("token", "password", "secret", "key"))) + dice.choice((" ", " is ", " was ")), dice.choice((human, lambda: mixed(dice.randint(9, 15))))()),
        lambda: (name(dice.choice(("api_key", "token", "secret"))) + dice.choice((" => ", join())), dice.choice((hexes, mixed))(dice.randint(9, 20))),
        lambda: (name(dice.choice(("password", "passwd", "pwd"))) + join(), dice.choice(".!+#*").join((word(), word(), dice.choice((digits(1) + word(), word() + digits(2)))))),
        lambda: (dice.choice(("id=", "?page=", "url?id=", "file=", "rev=")) + digits(dice.randint(1, 4)) + "&" + dice.choice(("token", "password", "api_key", "secret")) + "=", mixed(dice.randint(9, 24))),
        lambda: ('{"id":' + digits(2) + ',"' + dice.choice(("token", "password", "api_key", "secret")) + '":"', dice.choice((human(), mixed(dice.randint(9, 24))))),
        lambda: (dice.choice(("postgres", "mysql", "https", "redis", "amqp", "ftp")) + "://" + dice.choice((word(), "user", "")) + ":", dice.choice((human(), mixed(8), hexes(12), leet(word()) + marks(1)))),
        lambda: ("", "AKIA" + upper(16)),
        lambda: (name("access key") + join(), "AKIA" + upper(16)),
        lambda: (name("token") + join(), dice.choice((hexes, mixed))(dice.choice((24, 32, 40, 64)))),
        lambda: (name("password") + dice.choice(("=", ": ", " = ", '="')), dice.choice((hexes, mixed))(dice.randint(10, 24))),
        lambda: (name("api_key") + join(), dice.choice((hexes, mixed))(dice.choice((32, 39, 40)))),
        lambda: (name("secret") + join(), mixed(40, "+/")),
        lambda: ("", dice.choice(("ghp_", "gho_")) + mixed(36)),
        lambda: ("", "sk-" + mixed(dice.choice((32, 48)))),
        lambda: ("Authorization: Bearer ", "eyJ" + mixed(dice.randint(30, 60), "_-")),
    ]
    other = [
        lambda: (name(dice.choice(("password", "token", "secret", "key", "access"))) + dice.choice((" ", " is ", ": ", "=")), word() + dice.choice(("", ".", ","))),
        lambda: (name(dice.choice(("password", "token", "api_key"))) + join(), dice.choice(("<{}>", "${{{}}}", "%{}%", "[{}]", "{{{{{}}}}}")).format(dice.choice((word(), f"your-{word()}", "PASSWORD")))),
        lambda: (name(dice.choice(("password", "token", "secret"))) + join(), dice.choice(("None", "null", "required", "********", "xxxxxxxx", "changeable", "string", "os.environ"))),
        lambda: (word() + dice.choice((": ", "=", " => ", " = ")), dice.choice((word(), digits(5), f"{word()}@{word()}.com", f"${digits(2)}.{digits(2)}", f"{word()}.com:{digits(4)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"0.{digits(4)}", f"{word()}.{word()}()", f"{word()}, {word()}"))),
        lambda: (dice.choice(("https://", "see http://")) + word() + ".com:", digits(4) + "/" + word()),
        lambda: ("", word() + "-" + word() + "-" + word() + word()),
        lambda: ("", "-" * dice.randint(16, 40)),
        lambda: (dice.choice(("commit ", "rev ", "sha1: ", "revision=", "parent ")), hexes(40)),
        lambda: (dice.choice(("sha256: ", "sha256=", "digest: ", "checksum ")), hexes(64)),
        lambda: (dice.choice(("md5 ", "md5: ", "etag=", 'etag: "', "hash: ")), hexes(32)),
        lambda: (dice.choice(("uuid ", "id=", "guid: ", "")), "-".join((hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)))),
        lambda: (dice.choice(("", "card ", "no. ", "phone: ", "isbn ")), digits(dice.choice((16, 16, 17, 19, 20)))),
        lambda: ("", f"{dice.randint(1990, 2030)}-{dice.randint(1, 12):02}-{dice.randint(1, 28):02}T{digits(6)}"),
        lambda: (dice.choice(("/", "see /", "path: ", "file=", "https://example.com/")), "/".join(word() for _ in range(3)) + f"/v{digits(1)}/{word()}"),
        lambda: (dice.choice(("", "url: ", "id: ")), "-".join(word() for _ in range(4)) + "-" + digits(4)),
        lambda: ("", "".join(word().capitalize() for _ in range(3)) + digits(2)),
        lambda: (dice.choice(("image/png;base64,", "image: ", "file: ")), mixed(60, "+/")),
        lambda: (dice.choice(("name: ", "title=", "note: ")), "".join(word() for _ in range(3))),
        lambda: (dice.choice(("token ", "key: ", "password: ")), "_".join(word() for _ in range(3)) + digits(1)),
        lambda: ("", word() + "." + digits(2) + "-" + word() + word() + digits(3)),
    ]
    out = []
    for k in range(n):
        lead, body = dice.choice(secret if k % 2 else other)()
        before = " ".join(word() for _ in range(dice.randint(0, 8)))
        text = (before + " " if before else "") + lead
        end = "@" + word() + dice.choice((".com/", ":5432/", "/")) + word() if "://" in lead and k % 2 else dice.choice(("", '"', ".", ",", ""))
        found = text + body + end + " " + " ".join(mail() if dice.random() < 0.08 else word() for _ in range(4))
        for a, b in candidates(found):
            if (a, b) == (len(text), len(text) + len(body)):
                out.append((found, a, b, k % 2))
            elif not k % 2 or b <= len(text) or a >= len(text) + len(body):
                out.append((found, a, b, 0))
    return out


# ---------------------------------------------------------------- forest
class Forest:
    """Trees as arrays: feature, threshold, left, right, share of secrets in the leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5):
        dice = np.random.default_rng(seed)
        self.trees = [self._grown(x, y, dice) for _ in range(trees)]

    @staticmethod
    def _grown(x: np.ndarray, y: np.ndarray, dice: np.random.Generator) -> list[np.ndarray]:
        feature, limit, left, right, share = [], [], [], [], []
        todo = [(dice.integers(0, len(y), len(y)), 0, -1, False)]
        some = max(1, int(round(x.shape[1] ** 0.5)))
        while todo:
            rows, depth, parent, is_right = todo.pop()
            node = len(share)
            if parent >= 0:
                (right if is_right else left)[parent] = node
            p = float(y[rows].mean())
            for own, v in ((feature, -1), (limit, 0.0), (left, -1), (right, -1), (share, p)):
                own.append(v)
            if depth >= DEPTH or len(rows) < 2 * LEAF or p in (0.0, 1.0):
                continue
            best = (p * (1 - p) - 1e-9, -1, 0.0)
            for f in dice.choice(x.shape[1], some, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], y[rows][order]
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= LEAF) & (cut <= len(rows) - LEAF)]
                if not len(cut):
                    continue
                ones = np.cumsum(t)[cut - 1]
                n, all_n, all_ones = cut, len(rows), t.sum()
                pl, pr = ones / n, (all_ones - ones) / (all_n - n)
                gini = (n * pl * (1 - pl) + (all_n - n) * pr * (1 - pr)) / all_n
                k = int(gini.argmin())
                if gini[k] < best[0]:
                    best = (float(gini[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
            if best[1] < 0:
                continue
            feature[node], limit[node] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            todo += [(rows[low], depth + 1, node, False), (rows[~low], depth + 1, node, True)]
        return [np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(share)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees."""
        total = np.zeros(len(x))
        for feature, limit, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= limit[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


class Scanner:
    """A describer and a forest, ready for texts."""

    def __init__(self, words: list[str], findings: Iterable[tuple[str, int, int, int]] | None = None, lexicon: Lexicon | None = None):
        self.describer = Describer(lexicon or words)
        findings = labelled_findings(words) if findings is None else list(findings)
        x = np.array([self.describer.features(*f[:3]) for f in findings])
        self.forest = Forest(x, np.array([f[3] for f in findings], np.float64))

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, float]]:
        """(row, start, end, score) of every candidate, in order."""
        at = [(r, a, b) for r, t in enumerate(texts) if t for a, b in candidates(t)]
        if not at:
            return []
        x = np.array([self.describer.features(texts[r], a, b) for r, a, b in at])
        return [(*c, s) for c, s in zip(at, self.forest.scores(x).tolist())]


#: Ordinary words for the dictionary and the bigrams (fixed values); a corpus adds its own by ``dictionary``.
COMMON_WORDS = (
    "about after again also always another because before between both could does down during each even every example find first follow found from give good great have "
    "here house however important into just know large last later left life light like line list little long look made make many mean might more most move much must name "
    "need never next number often only open order other over page part people place point question read right same school second sentence should show side small some sound "
    "spell start state still stop story study such take tell than that their them then there these they thing think this those thought three through time together turn under "
    "until upon value very walk want water well were what when where which while white will with without word work world would write year young your"
).split()


def dictionary(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(w, count) of the lower-case words of 4 to 14 letters that all texts together hold ``least`` times or more."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(4, 14))
    return words.groupBy("w").count().where(F.col("count") >= least)


#: Words that a part of the filter may hold: at 2**26 bits and four probes it then takes 2 in 10,000 other strings for words.
CAPACITY = 2_000_000
#: 64-bit words of a piece in which the filter comes to the driver (64 KB).
PIECE = 1 << 13


def frequent(words: DataFrame) -> DataFrame:
    """The words of ``dictionary`` that are as frequent as it takes for at most ``CAPACITY`` of them: counts from 2, 4, 8 and so on.
    For who wants a lexicon of one part; ``fit`` takes all words."""
    levels = [2**k for k in range(1, 48)]
    left = words.agg(*[F.count(F.when(F.col("count") >= n, 1)) for n in levels]).first()
    return words.where(F.col("count") >= next(n for n, own in zip(levels, left) if own <= CAPACITY or n == levels[-1]))


def lexicon(words: DataFrame, more: Iterable[str] = ()) -> Lexicon:
    """The lexicon of all of the column w and of ``more``. Its filter has as many parts as they need, so that it stays as sparse however
    many they are. Tasks put pieces of it together; the driver only gets these."""
    common = [w for w in dict.fromkeys(more) if len(w) >= 4]
    rest = words.select("w").where(~F.col("w").isin(common))
    out = Lexicon(common, max(1, -(-(rest.count() + len(common)) // CAPACITY)))
    size, piece = 64 * len(out.filter), min(PIECE, len(out.filter))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = np.zeros(27 * 27, np.int64)
        for batch in batches:
            at = np.unique(Lexicon.places(batch.column("w"), size)).astype(np.int64)
            bigrams += Lexicon.pairs(batch.column("w"))
            yield pa.RecordBatch.from_pydict({"piece": at // (64 * piece), "at": at % (64 * piece), "n": np.zeros(len(at), np.int64)})
        own = np.flatnonzero(bigrams)
        yield pa.RecordBatch.from_pydict({"piece": np.full(len(own), -1), "at": own, "n": bigrams[own]})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            which, at, n = (batch.column(c).to_numpy() for c in ("piece", "at", "n"))
            for k in np.unique(which).tolist():
                own = which == k
                if k < 0:
                    np.add.at(found.setdefault(k, np.zeros(27 * 27, np.int64)), at[own], n[own])
                else:
                    np.bitwise_or.at(found.setdefault(k, np.zeros(piece, np.uint64)), at[own] >> 6, np.uint64(1) << (at[own] & 63).astype(np.uint64))
        for k, own in found.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "data": pa.array([own.tobytes()], pa.binary())})

    rows = rest.mapInArrow(set_bits, "piece long, at long, n long").repartition("piece")
    for k, data in rows.mapInArrow(pieces, "piece long, data binary").toLocalIterator():
        if k < 0:
            out.bigrams += np.frombuffer(data, np.int64)
        else:
            out.filter[k * piece : (k + 1) * piece] |= np.frombuffer(data, np.uint64)
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", findings: Iterable[tuple[str, int, int, int]] | None = None) -> Scanner:
    """A scanner for texts like these; ``findings`` are reviewed (text, start, end, label) rows. Where none are given, a bounded number
    is generated in sentences of common words and of the corpus's most frequent ones; the features rest on all words of all texts."""
    words = dictionary(docs, text).persist()
    known = lexicon(words, COMMON_WORDS)
    sentence = [r[0] for r in words.orderBy(F.desc("count"), "w").limit(SENTENCE_WORDS).toLocalIterator()] if findings is None else []
    words.unpersist()
    scanner = Scanner([*COMMON_WORDS, *sentence], findings, known)
    trim()
    return scanner


def findings(docs: DataFrame, scanner: Scanner, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, start, n_chars, value_sha256, score, is_secret) of every candidate; the value itself isn't passed on."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                got = shared.value.scan(texts)
                yield pa.RecordBatch.from_pydict({
                    key: part.column(key).take(pa.array([g[0] for g in got], pa.int64())),
                    "start": pa.array([g[1] for g in got], pa.int64()),
                    "n_chars": pa.array([g[2] - g[1] for g in got], pa.int64()),
                    "value_sha256": pa.array([hashlib.sha256(texts[r][a:b].encode()).hexdigest() for r, a, b, _ in got], pa.string()),
                    "score": pa.array([round(g[3], 6) for g in got], pa.float64()),
                    "is_secret": pa.array([g[3] >= threshold for g in got], pa.bool_()),
                })

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, start long, n_chars long, value_sha256 string, score double, is_secret boolean")


def joined(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, end) in order, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for r, a, b in spans:
        if out and out[-1][0] == r and a < out[-1][2]:
            out[-1] = (r, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((r, a, b))
    return out


def redacted(docs: DataFrame, scanner: Scanner, text: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns, with ``mark`` in place of every secret; nothing else changes."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                for r, a, b in reversed(joined((r, a, b) for r, a, b, s in shared.value.scan(texts) if s >= threshold)):
                    texts[r] = texts[r][:a] + mark + texts[r][b:]
                yield part.set_column(at, text, pa.array(texts, part.schema.field(text).type))

    return docs.mapInArrow(run, docs.schema)
