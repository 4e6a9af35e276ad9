"""Secret scans: fixed expressions give the base spans, a linear-chain conditional random field tags further ones."""
from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.llm.common import base, checkpointed, digest, id_out, map_arrow

#: Kinds in the order of results.
KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HEX_ONLY = re.compile(r"[0-9a-f]+")
#: Words that announce a secret, and beginnings of well-known kinds of keys.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential", "auth", "bearer", "private")
PREFIXES = ("AKIA", "ghp_", "sk-", "xox", "eyJ", "glpat-", "AIza")

TOKEN = re.compile(r"[^\W_](?:[\w+/.-]*[^\W])?|_+|[^\w\s]")
VOWELS = "aeiou"
KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: Tagged spans shorter than this are no credible secrets.
MIN_TAGGED = 8
AROUND = 4  # tokens on either side of a notable one that are learnt with it
OUTSIDE, BEGIN, INSIDE = range(3)
#: Documents to learn from, in expectation (a hash of the id selects them).
SAMPLE = 4000

PLAIN = ("lower", "cap", "upper", "mark")  # shapes whose length says nothing; tokens of any other type are notable
SIGNS = ("=", ":", '"')
RICH = ("long upper", "mixed", "digits", "hex", "alnum", "rich")
SIZES = (8, 12, 16, 24, 40)
LEVELS = 3  # how little a token looks like words and numbers, see wildness
SIMPLE = PLAIN + SIGNS + CUES + PREFIXES
TYPES = len(SIMPLE) + len(RICH) * (len(SIZES) + 1) * LEVELS
FILES = 4  # kinds of texts: prose or dense in assignments, short or long
WINDOW = (-2, -1, 0, 1)  # neighbours whose types a token's score sees


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    low = text.lower()
    out = [("assign", *m.span()) for m in (ASSIGN.finditer(text) if any(k in low for k in KEYWORDS) else ())
           if m.end(1) - m.start(1) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def wildness(t: str) -> int:
    """0 to 2: random strings change between digits, small and capital letters more often than names and numbers do, have
    fewer vowels and longer runs of consonants, and capitals beside each other that start no word."""
    last, caps, swaps, turns, pairs, vowels, letters, run, longest, small, big = "", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
    for c in t:
        if not c.isalnum():
            run = 0
            continue
        kind = "d" if c.isdigit() else "u" if c.isupper() else "l"
        if last and kind != last:
            swaps += "d" in (kind, last)
            turns += "d" not in (kind, last)
        if kind == "l" and caps >= 2:
            run = 0  # the end of an acronym
        caps = caps + 1 if kind == "u" else 0
        pairs += kind == "u" and caps > 1
        last = kind
        if kind == "d":
            run = 0
            continue
        letters += 1
        small += kind == "l"
        big += kind == "u"
        soft = c.lower() in VOWELS or not c.isascii()
        vowels += soft
        run = 0 if soft else run + 1
        longest = max(longest, run)
    signs = ((swaps >= 4) + (swaps >= 8) + (small >= 3 and big >= 3 and pairs >= 2 and turns >= 0.35 * (letters - 1))
             + (letters >= 8 and vowels <= 0.27 * letters) + (longest >= 6))
    return min(LEVELS - 1, signs)


def token_type(t: str) -> int:
    """Cue, known beginning, or shape with length and wildness."""
    low = t.lower()
    if low in CUES or t in SIGNS:
        return SIMPLE.index(low)
    if not t[0].isalnum():
        return SIMPLE.index("mark")
    if t.isalpha():
        if t.isupper() and len(t) < 8:
            return SIMPLE.index("upper")
        if t.islower() or t[1:].islower():
            return SIMPLE.index("lower" if t.islower() else "cap")
    n = len(t)
    wild = wildness(t)
    if n >= 12 and wild:
        for p in PREFIXES:
            if t.startswith(p):
                return SIMPLE.index(p)
    shape = ("long upper" if t.isalpha() and t.isupper() else "mixed" if t.isalpha() else "digits" if t.isdigit()
             else "hex" if HEX_ONLY.fullmatch(t) else "alnum" if t.isalnum() else "rich")
    return len(SIMPLE) + (RICH.index(shape) * (len(SIZES) + 1) + sum(n >= s for s in SIZES)) * LEVELS + wild


def file_kind(text: str) -> int:
    dense = (text.count("=") + text.count(":") + text.count("{")) * 200 > len(text)
    return 2 * dense + (len(text) > 2000)


class _Types(dict):
    """Token types, kept for short tokens."""

    def __missing__(self, t: str) -> int:
        k = token_type(t)
        if len(t) <= 24:
            if len(self) >= 1 << 17:
                self.clear()
            self[t] = k
        return k


_TYPE_OF = _Types()


def token_types(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_TYPE_OF.__getitem__, tokens), np.int64, len(tokens))


def _stretches(on: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def regions(types: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of tokens around notable ones, merged where they touch; examples are taken from them."""
    on = np.zeros(len(types), bool)
    at = np.flatnonzero(types >= len(PLAIN))
    for k in range(-AROUND, AROUND + 1):
        on[np.clip(at + k, 0, len(types) - 1)] = True
    return _stretches(on)


@dataclass
class Model:
    emit: np.ndarray  # window place, type, tag
    file: np.ndarray  # kind of text, tag
    step: np.ndarray  # tag, next tag

    def scores(self, types: np.ndarray, kind: int) -> np.ndarray:
        """Tag scores of a token sequence; beyond its ends lie plain words."""
        pad = np.concatenate([[0, 0], types, [0]])
        return sum(self.emit[k, pad[2 + w:2 + w + len(types)]] for k, w in enumerate(WINDOW)) + self.file[kind]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0].tolist(), []
        step = self.step.tolist()
        for row in scores[1:].tolist():
            came = [max(range(3), key=lambda a: best[a] + step[a][b]) for b in range(3)]
            back.append(came)
            best = [best[came[b]] + step[came[b]][b] + row[b] for b in range(3)]
        tags = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]

    def tags(self, types: np.ndarray, kind: int) -> np.ndarray:
        """The best tagging of a whole text. A token whose own score for outside leads by more than the steps to its
        neighbours can give back is outside in every best tagging, whatever they are; Viterbi decodes the stretches
        between such tokens, so the result is that of decoding the text in one piece."""
        out = np.full(len(types), OUTSIDE)
        if not len(types):
            return out
        s, step = self.scores(types, kind), self.step
        sure = np.ones(len(types), bool)
        for y in (BEGIN, INSIDE):
            give = (step[:, y] - step[:, OUTSIDE]).max() + (step[y] - step[OUTSIDE]).max()
            sure &= s[:, OUTSIDE] - s[:, y] > give + 1e-9
        sure[[0, -1]] = False  # a step less
        for a, b in _stretches(~sure):
            part = s[a:b].copy()
            if a > 0:
                part[0] += step[OUTSIDE]
            if b < len(types):
                part[-1] += step[:, OUTSIDE]
            out[a:b] = self.viterbi(part)
        return out


def tagged(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the tokens tagged begin and those inside that follow."""
    tags = model.tags(token_types(TOKEN.findall(text)), file_kind(text))
    found = np.flatnonzero(tags != OUTSIDE)
    if not len(found):
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    out: list[tuple[int, int]] = []
    last = -2
    for k in found.tolist():
        if tags[k] == INSIDE and k == last + 1:
            out[-1] = (out[-1][0], spans[k][1])
        else:
            out.append(spans[k])
        last = k
    return [_padded(text, s, e) for s, e in out if e - s >= MIN_TAGGED]


def _padded(text: str, s: int, e: int) -> tuple[int, int]:
    """Signs of the base-64 alphabet at the edges, which begin or end no token, belong to the secret."""
    while s > 0 and text[s - 1] in "+/":
        s -= 1
    while e < len(text) and text[e] in "+/=":
        e += 1
    return s, e


def beyond(text: str, start: int, end: int, own: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What a span covers outside the base spans, without the blanks and signs at the cuts; a piece that holds no letter or
    digit is left out."""
    cuts = sorted((s, e) for _, s, e in own if s < end and start < e)
    out, at = [], start
    for s, e in [*cuts, (end, end)]:
        a, b = at, s
        while a < b and at > start and not text[a].isalnum():
            a += 1
        while a < b and s < end and not text[b - 1].isalnum():
            b -= 1
        if any(c.isalnum() for c in text[a:b]):
            out.append((a, b))
        at = max(at, e)
    return out


_LOW, _UP, _NUM = string.ascii_lowercase, string.ascii_uppercase, string.digits
_MANY = _LOW + _UP + _NUM
WIDTH = 14  # tokens of a training sequence, at most
#: Training sequences without a secret, at most; those left out are made up for by weight. And secrets and look-alikes
#: made up for each document of the sample.
MAX_OUTSIDE, MADE = 12_000, 2


def made_secret(rng: random.Random) -> str:
    """A value of one of the usual kinds of keys."""
    def some(pool, n):
        return "".join(rng.choices(pool, k=n))
    n = rng.randint(16, 64)
    kind = rng.randrange(11)
    if kind == 0:
        return some(_MANY + "+/", n)
    if kind == 1:
        return some(_LOW + _NUM, n)
    if kind == 2:
        return some(_UP + _NUM, n)
    if kind == 3:
        return some(rng.choice(("0123456789abcdef", "0123456789ABCDEF")), n)
    if kind == 4:
        return rng.choice(PREFIXES) + some(_MANY, n)
    if kind == 5:
        return f"eyJ{some(_MANY, 17)}.eyJ{some(_MANY, n)}.{some(_MANY + '-_', 42)}A"
    if kind == 6:
        hexa = some(rng.choice(("0123456789abcdef", "0123456789ABCDEF")), 32)
        return "-".join((hexa[:8], hexa[8:12], hexa[12:16], hexa[16:20], hexa[20:]))
    if kind in (7, 10):  # the hardest kind comes twice
        return some(_LOW + _UP, n)
    if kind == 8:
        return some(_MANY + "._-", n - 1) + "k"
    return some(_MANY, n)


def made_harmless(rng: random.Random) -> str:
    """What looks like a key at first sight: dates, versions, numbers, paths, names in camel case and the like."""
    def word():
        return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "st")) for _ in range(rng.randint(1, 4)))

    def number(n):
        return "".join(rng.choices(_NUM, k=n))
    words = [word() for _ in range(rng.randint(2, 6))]
    kind = rng.randrange(13)
    if kind == 0:
        return f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(("", f"T{number(2)}:{number(2)}:{number(2)}Z"))
    if kind == 1:
        return f"{rng.randint(1, 28)}{rng.choice('./')}{rng.randint(1, 12)}{rng.choice('./')}{rng.randint(1900, 2100)}"
    if kind == 2:
        return rng.choice(("", "v")) + ".".join(number(rng.randint(1, 2)) for _ in range(rng.randint(2, 4))) + rng.choice(("", "-rc1", "-beta.2", "a1"))
    if kind == 3:
        return number(rng.randint(1, 16))
    if kind == 4:
        return "-".join(number(rng.randint(1, 5)) for _ in range(rng.randint(2, 5)))
    if kind == 5:
        return "https://" + rng.choice(("", "www.")) + "/".join([f"{words[0]}.{rng.choice(('org', 'com', 'de'))}", *words[1:]]) + rng.choice(
            ("", ".html", f"-{number(4)}.html", f"/{number(3)}", f"?id={number(5)}"))
    if kind == 6:
        return words[0] + "".join(w.capitalize() for w in words[1:])
    if kind == 7:
        return rng.choice(("XML", "HTTP", "SQL", "URL")) + "".join(w.capitalize() for w in words) + rng.choice(("", "2", "V2", "ID"))
    if kind == 8:
        return rng.choice("_-").join(words) + rng.choice(("", "", number(2)))
    if kind == 9:
        return "_".join(words).upper()
    if kind == 10:
        return f"{words[0]}.{words[1]}{rng.choice(('', number(2)))}@{words[-1]}.{rng.choice(('org', 'com'))}"
    if kind == 11:
        return rng.choice(_UP) + number(rng.randint(1, 4)) + rng.choice(("", "-" + number(3), rng.choice(_UP)))
    return "/" + "/".join(words) + rng.choice(("", ".so.6", ".py", ".tar.gz"))


def made_sequence(tokens: list[str], rng: random.Random, secret: bool) -> tuple[list[int], list[int]]:
    """Types and tags of a made value set between tokens of a text, behind a cue or not."""
    at = rng.randint(0, len(tokens))
    value = made_secret(rng) if secret else made_harmless(rng)
    lead = rng.choice(("", "", "", "{c} ", "{c}: ", "{c} = ", '{c}="', "{c} {c}: ", "bearer ")) if secret else rng.choice(("", "", "", '"', ": ", "= "))
    before = tokens[max(0, at - AROUND):at] + TOKEN.findall(lead.format(c=rng.choice(CUES)))
    own = TOKEN.findall(value)
    after = (['"'] if lead.endswith('"') else []) + tokens[at:at + AROUND]
    tags = [OUTSIDE] * len(before) + ([BEGIN] + [INSIDE] * (len(own) - 1) if secret else [OUTSIDE] * len(own)) + [OUTSIDE] * len(after)
    return token_types(before + own + after).tolist(), tags


def _examples(batches):
    """Token types and tags: the values of base spans that are no plain numbers are secrets; what else stands around
    notable tokens is outside, unless a token there is as wild as a secret (it may be one that no expression knows).
    Made values between the text's own tokens add the kinds of keys, and of harmless strings, that base spans lack."""
    for b in batches:
        out: dict[str, list] = {"types": [], "tags": [], "kind": []}
        for t in b.column(1):
            text = t.as_py()
            secret = [(m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
            secret += [(s, e) for k, s, e in base_spans(text) if k != "assign" and not text[s:e].isdigit()]
            secret.sort()
            found = list(TOKEN.finditer(text))
            tokens = [m[0] for m in found]
            whole = token_types(tokens)
            kind = file_kind(text)
            rng = random.Random(zlib.crc32(text.encode()))
            for a, z in regions(whole):
                inside = [any(s <= m.start() and m.end() <= e + 1 for s, e in secret) for m in found[a:z]]
                tags = [OUTSIDE if not i else INSIDE if k and inside[k - 1] else BEGIN for k, i in enumerate(inside)]
                for k in range(0, z - a, WIDTH):
                    part = tokens[a + k:min(z, a + k + WIDTH)]
                    if any(g == OUTSIDE and len(w) >= 16 and not w.isdigit() and wildness(w) == LEVELS - 1 for w, g in zip(part, tags[k:])):
                        continue
                    out["types"].append(whole[a + k:a + k + len(part)].tolist())
                    out["tags"].append(tags[k:k + len(part)])
                    out["kind"].append(kind)
            for k in range(2 * MADE):
                types, tags = made_sequence(tokens, rng, k % 2 == 0)
                out["types"].append(types[:2 * WIDTH])
                out["tags"].append(tags[:2 * WIDTH])
                out["kind"].append(kind)
        yield out


def fit(types: list[np.ndarray], tags: list[np.ndarray], kinds: list[int], weights: list[float] | None = None,
        rounds: int = 150, decay: float = 0.02) -> Model:
    """Maximum conditional likelihood with a quadratic penalty; gradients by the forward-backward recursions. weights:
    how often each sequence occurs."""
    n, width = len(types), max(map(len, types))
    t, y, on = np.zeros((n, width + 3), int), np.zeros((n, width), int), np.zeros((n, width), bool)
    for k, (a, b) in enumerate(zip(types, tags)):
        t[k, 2:2 + len(a)], y[k, :len(b)], on[k, :len(a)] = a, b, True
    kind = np.asarray(kinds)
    shapes = [(len(WINDOW), TYPES, 3), (FILES, 3), (3, 3)]
    theta = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    often = np.ones(n) if weights is None else np.asarray(weights, float)
    hot = np.eye(3)[y] * on[:, :, None]
    pairs = on[:, 1:]
    total = often.sum()
    places = [t[:, 2 + w:2 + w + width].ravel() for w in WINDOW]
    for r in range(1, rounds + 1):
        emit, file, step = theta
        s = sum(emit[k][t[:, 2 + w:2 + w + width]] for k, w in enumerate(WINDOW)) + file[kind][:, None]
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for k in range(1, width):
            a = np.logaddexp.reduce(alpha[:, k - 1, :, None] + step, axis=1) + s[:, k]
            alpha[:, k] = np.where(on[:, k, None], a, alpha[:, k - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for k in range(width - 2, -1, -1):
            b = np.logaddexp.reduce(step + (s[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(on[:, k + 1, None], b, 0)
        p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + step + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        joint *= (pairs * often[:, None])[:, :, None, None]
        diff = (hot - p) * often[:, None, None]
        g_emit = np.stack([np.stack([np.bincount(at, diff[:, :, tag].ravel(), TYPES) for tag in range(3)], axis=1) for at in places])
        g_file = np.stack([np.bincount(kind, diff[:, :, tag].sum(axis=1), FILES) for tag in range(3)], axis=1)
        g_step = np.einsum("n,nka,nkb->ab", often, hot[:, :-1] * pairs[:, :, None], hot[:, 1:]) - joint.sum(axis=(0, 1))
        for j, g in enumerate((g_emit, g_file, g_step)):
            g = g / total - decay / total * theta[j]
            mean[j] = 0.9 * mean[j] + 0.1 * g
            square[j] = 0.999 * square[j] + 0.001 * g * g
            theta[j] = theta[j] + 0.1 * (mean[j] / (1 - 0.9 ** r)) / (np.sqrt(square[j] / (1 - 0.999 ** r)) + 1e-8)
    return Model(*theta)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Sequences without a secret weigh twice as much as those with one, together."""
    has = np.array([BEGIN in t for t in rows["tags"]], bool)
    if not has.any():
        return pd.DataFrame({"emit": [], "file": [], "step": []})
    often = rows["often"].to_numpy(float)
    if not has.all():
        often = np.where(has, often, often * min(1.0, 2 * often[has].sum() / often[~has].sum()))
    m = fit([np.asarray(t) for t in rows["types"]], [np.asarray(t) for t in rows["tags"]], rows["kind"].tolist(), often)
    return pd.DataFrame({"emit": [m.emit.tobytes()], "file": [m.file.tobytes()], "step": [m.step.tobytes()]})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
          max_outside: int = MAX_OUTSIDE) -> Model | None:
    """A model from about `sample` whole documents. Sequences of equal types and tags are counted; of those without a secret
    the max_outside with the lowest hashes go on, scaled up to all of them, so the fit has a bounded size. None when no document holds a
    token."""
    total = docs.count()
    h = F.crc32(F.concat(F.lit("scan "), F.coalesce(F.col(id_col).cast("string"), digest(text_col))).cast("binary"))
    chosen = docs.where(h < min(1.0, sample / max(1, total)) * 2.0 ** 32)
    rows = checkpointed(map_arrow(base(chosen, id_col, text_col).where("_text <> ''"), _examples, "types array<int>, tags array<int>, kind int")
                        .groupBy("types", "tags", "kind").agg(F.count(F.lit(1)).alias("often")))
    has = F.array_contains("tags", BEGIN)
    outside = rows.where(~has)
    few = outside.orderBy(F.xxhash64("types", "kind")).limit(max_outside)
    all_, kept = (x.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0] for x in (outside, few))
    few = few.withColumn("often", F.col("often") * F.lit(all_ / max(1, kept)))
    got = rows.where(has).withColumn("often", F.col("often").cast("double")).unionByName(few).withColumn("_g", F.lit(0)).groupBy(
        "_g").applyInPandas(_fit, "emit binary, file binary, step binary").collect()
    if not got:
        return None
    return Model(np.frombuffer(got[0]["emit"]).reshape(len(WINDOW), TYPES, 3), np.frombuffer(got[0]["file"]).reshape(FILES, 3),
                 np.frombuffer(got[0]["step"]).reshape(3, 3))


def find_secrets(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of kind, start, end and the text found; one row per row of docs, spans by start, then kind.

    Base spans always stay. The model tags all tokens as secret begin, inside or outside with the Viterbi algorithm; what a tagged span covers beyond the base spans is added as 'tagged'. Null and empty texts give an empty
    array, a null id stays null, repeated rows give repeated results, empty input gives an empty result; without a model
    only base spans are given. Each text is read once and nothing is shuffled."""
    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py()
                own = base_spans(text)
                if model:
                    more = [("tagged", s, e) for a, b in tagged(text, model) for s, e in beyond(text, a, b, own)]
                    own = sorted(own + more, key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": s, "end": e, "found": text[s:e]} for k, s, e in own])
            yield {"_id": b.column(0), "spans": out}
    return map_arrow(base(docs, id_col, text_col), run,
                     "_id long, spans array<struct<kind:string,start:long,end:long,found:string>>").select(id_out(), "spans")
