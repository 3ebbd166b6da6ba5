"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import long_rows, tidy

# The base patterns, the least lengths of what they find, and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
LEAST, MOST = 20, 512  # characters of a candidate that is scored; longer ones are scored whole, then in windows of MOST
CUTS, EDGE = "=/.", "-_.=/+"  # where a candidate is cut, in this order, and what may stand before or after a credential
WHOLE = 0.1  # by how much a symbol its parts must be likelier than a whole that is typical of a format
MARK = math.log(1 / 12)  # the log likelihood of a mark at which a candidate is cut

END = "$"
SHAPES = "".join("0" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "H" if c in "ABCDEF" else "U" if c.isupper() else c for c in map(chr, range(128)))
HEAD = 5  # characters at the start that count as themselves; later ones count as their class
TOKEN = re.compile(r"[A-Za-z0-9+/]+")


def symbols(word: str) -> str:
    """The texture of a word: its characters' classes, after a head that stands for itself."""
    return word[:HEAD] + word[HEAD:].translate(SHAPES)


def token_class(m: re.Match) -> str:
    """As many symbols as the token has characters, the same one: which kinds of characters it is made of."""
    t = m[0]
    lower, upper, digit, other = re.search("[a-z]", t), re.search("[A-Z]", t), re.search("[0-9]", t), re.search("[+/]", t)
    if lower and upper and digit:
        kind = "B" if other else "M"
    elif other:
        kind = "p"
    elif lower and digit:
        kind = "a" if re.search("[g-z]", t) else "x"
    elif upper and digit:
        kind = "A" if re.search("[G-Z]", t) else "X"
    else:
        kind = "m" if lower and upper else "l" if lower else "u" if upper else "0"
    return kind * len(t)


def shape(word: str) -> str:
    """The shape of a word: the classes and lengths of its tokens, and what stands between them."""
    return TOKEN.sub(token_class, word)


class Automaton:
    """Chances of symbols by state: moves[state][symbol] = (next state, chance); END ends a word. A share of every chance
    is kept for symbols that a state has not seen, the same for each symbol that may stand there: there are more of them
    in the first `head` places."""

    def __init__(self, moves: list[dict[str, tuple[int, float]]], head: int = HEAD, unseen: float = 0.05):
        self.head = head
        first, later = unseen / 67, unseen / 12  # that many symbols, the end included
        self.moves = [{c: (to, math.log((1 - unseen) * p + first), math.log((1 - unseen) * p + later)) for c, (to, p) in m.items()} for m in moves]
        self.rare = (math.log(first), math.log(later))

    def strange(self, word: str) -> int:
        """How many symbols of a word, its end among them, the automaton has not seen where they stand."""
        state, out = 0, 0
        for c in word + END:
            found = self.moves[state].get(c)
            if found is None:
                out += 1
            else:
                state = found[0]
        return out

    def score(self, word: str) -> float:
        """Log likelihood of a word; at a symbol that it has not seen the automaton stays in its state."""
        state, total, moves, head = 0, 0.0, self.moves, self.head
        for i, c in enumerate(word + END):
            found = moves[state].get(c)
            if found is None:
                total += self.rare[i >= head]
            else:
                total += found[1 + (i >= head)]
                state = found[0]
        return total


def infer(words: list[str], alpha: float = 0.05, head: int = HEAD) -> Automaton:
    """Merges the states of the words' prefix tree whose frequencies are compatible, in breadth-first order.

    Two states are compatible when for every symbol, and for the end, their relative frequencies differ by no more than
    Hoeffding's bound at `alpha`, and so do the states that follow. A state that is compatible with none is kept."""
    kids: list[dict[str, int]] = [{}]
    passed: list[Counter] = [Counter()]
    for w in words:
        at = 0
        for c in w:
            passed[at][c] += 1
            if c not in kids[at]:
                kids[at][c] = len(kids)
                kids.append({})
                passed.append(Counter())
            at = kids[at][c]
        passed[at][END] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if a == b:
                continue
            n, m = sum(passed[a].values()), sum(passed[b].values())
            if not n or not m:
                continue
            most = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most < 1:
                for c in passed[a].keys() | passed[b].keys():
                    if abs(passed[a][c] / n - passed[b][c] / m) > most:
                        return False
                pairs += [(kids[a][c], kids[b][c]) for c in kids[a].keys() & kids[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            passed[a].update(passed[b])
            for c, k in kids[b].items():
                if c in kids[a]:
                    if kids[a][c] != k:
                        pairs.append((kids[a][c], k))
                else:
                    kids[a][c] = k

    red, kept = [0], {0}
    while blue := next(((r, c) for r in red for c in sorted(kids[r]) if kids[r][c] not in kept), None):
        r, c = blue
        state = kids[r][c]
        home = next((x for x in red if alike(x, state)), None)
        if home is None:
            red.append(state)
            kept.add(state)
        else:
            kids[r][c] = home
            fold(home, state)
    place = {s: i for i, s in enumerate(red)}
    moves = []
    for s in red:
        n = sum(passed[s].values())
        moves.append({c: (place[kids[s][c]] if c != END else 0, k / n) for c, k in passed[s].items()})
    return Automaton(moves, head)


def labelled(seed: int = 4, each: int = 600) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Labelled examples, drawn from public formats: credentials by format, and words that are none."""
    rng = random.Random(seed)
    low, up, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    draw = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    whole = low + up + digit
    secrets = {
        "hexkey": lambda: draw(rng.choice((hexa, hexa.upper())), rng.choice((32, 40, 48, 64))),
        "accesskey": lambda: "AKIA" + draw(up + digit, 16),
        "hubtoken": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + draw(whole, 36),
        "paykey": lambda: rng.choice(("sk_live_", "sk_test_", "rk_live_")) + draw(whole, 24),
        "chattoken": lambda: rng.choice(("xoxb-", "xoxp-")) + draw(digit, 12) + "-" + draw(digit, 12) + "-" + draw(whole, 24),
        "webtoken": lambda: "eyJ" + draw(whole, rng.randint(17, 40)) + ".eyJ" + draw(whole, 20 + int(rng.expovariate(0.01))) + "." + draw(whole + "-_", rng.choice((43, 86, 342))),
        "base64key": lambda: draw(whole + "+/", 40) if rng.random() < 0.4 else draw(whole + "+/", 43) + rng.choice(("", "=")),
        "longkey": lambda: draw(whole, 64 + int(rng.expovariate(0.01))),
    }
    ends = ("tion", "ing", "er", "the", "and", "ment", "que", "ung", "ción", "able")
    part = lambda: "".join(c for c in draw("aeiou" + low, rng.randint(1, 4)) + rng.choice(ends) if c.isascii())
    word = lambda: "".join(part() for _ in range(rng.randint(1, 6)))
    short = lambda: "".join(part() for _ in range(rng.randint(1, 2)))
    number = lambda a, b: draw(digit, rng.randint(a, b))
    day = lambda: f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}"
    hour = lambda: f"{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}"
    version = lambda: ".".join(number(1, 2) for _ in range(rng.randint(2, 4)))
    tail = lambda: rng.choice((".jpg", ".png", ".html", ".tar.gz", ".pdf", ".py", ".csv", ".MP4", ""))
    uuid = lambda of: "-".join(draw(of, n) for n in (8, 4, 4, 4, 12))
    case = lambda w: rng.choice((w, w.upper(), w.title()))
    plain = [
        lambda: "".join(part() for _ in range(rng.randint(4, 9))),
        lambda: "".join(part() for _ in range(rng.randint(4, 9))).upper(),
        lambda: "".join(word().title() for _ in range(rng.randint(3, 6))),
        lambda: "".join(short().title() + rng.choice(("", "", "", number(1, 2))) for _ in range(rng.randint(3, 9))),
        lambda: "/".join(case(short()) + rng.choice(("", "", number(1, 3))) for _ in range(rng.randint(3, 9))),
        lambda: "www." + word() + ".example.com/" + word() + "/" + word() + "-" + number(1, 4) + ".html",
        lambda: "www." + short() + ".org/" + "/".join((day()[:4], day()[4:6])) + "/" + "-".join(short() for _ in range(rng.randint(2, 7))) + rng.choice(("", "-" + number(1, 8))) + tail(),
        lambda: word() + "." + number(2, 2) + rng.choice(("mail", "post")) + number(1, 1) + ".example.org",
        lambda: "_".join(word() for _ in range(rng.randint(3, 5))),
        lambda: "-".join(word() for _ in range(rng.randint(3, 5))),
        lambda: "_".join(rng.choice((short(), short(), number(1, 4))) for _ in range(rng.randint(3, 8))) + tail(),
        lambda: "-".join(case(rng.choice((short(), short(), number(1, 4)))) for _ in range(rng.randint(3, 8))) + tail(),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "/".join(rng.choice((short(), short() + version(), case(short()))) for _ in range(rng.randint(3, 7))) + tail(),
        lambda: number(16, 40),
        lambda: rng.choice(("", number(1, 3) + ".")) + number(18, 40),
        lambda: "-".join(number(4, 4) for _ in range(rng.randint(4, 6))),
        lambda: uuid(hexa),
        lambda: uuid(hexa.upper()),
        lambda: uuid(hexa) + rng.choice((".", "_", "-")) + short() + tail(),
        lambda: rng.choice(("IMG_", "VID-", "PXL_", "Screenshot_", "scan-", "DSC_")) + day() + rng.choice("_-") + hour() + rng.choice(("", number(3, 3), "-" + case(short()))) + tail(),
        lambda: rng.choice(("v", "")) + version() + rng.choice(("-alpha", "-beta.1", "-rc2", "")) + "+build" + day() + "T" + hour(),
        lambda: short() + rng.choice("-_") + version() + rng.choice("-_") + number(1, 2) + rng.choice(("ubuntu1_amd64.deb", "-py3-none-any.whl", ".el8.x86_64.rpm", "_arm64.deb", "-linux-x86_64.tar.gz")),
        lambda: f"{day()}T{hour()}Z" + rng.choice(("-", "_", ".")) + short() + number(1, 4) + tail(),
        lambda: "-".join((day()[:4], day()[4:6], day()[6:])) + rng.choice(("T", "_", "-")) + "-".join((hour()[:2], hour()[2:4], hour()[4:])) + rng.choice(("", "." + number(3, 6), "Z", "+00")),
        lambda: "-".join(draw(up, rng.randint(2, 4)) if rng.random() < 0.5 else number(2, 5) for _ in range(rng.randint(4, 7))),
        lambda: rng.choice(("sha256-", "etag-", "build-", "rev-")) + day() + "-" + short() + "-" + number(2, 6),
        lambda: rng.choice("=-_.") * rng.randint(20, 80),
    ]
    return {k: [f() for _ in range(each)] for k, f in secrets.items()}, {str(k): [x for x in (f() for _ in range(each)) if len(x) >= LEAST] for k, f in enumerate(plain)}


class Format:
    """Two automata of one format: of its words' shapes, which tells tokens and lengths, and of their texture."""

    def __init__(self, words: list[str]):
        self.shape, self.texture = infer([shape(w) for w in words], head=0), infer([symbols(w) for w in words])

    def score(self, word: str) -> float:
        return self.shape.score(shape(word)) + self.texture.score(symbols(word))


class Model:
    """Automata of the formats and of kinds of what is no credential; for each format the least lead over the latter,
    and what is typical: the least log likelihood, a symbol each, the least length, and how many symbols of the shape may
    be strange. joined: lengths of credentials that have a `/` inside."""

    def __init__(self, formats: dict[str, Format], plain: dict[str, Format], least: dict[str, float], floor: dict[str, float], short: dict[str, int], joined: set[int]):
        self.formats, self.plain, self.least, self.floor, self.short, self.joined = formats, plain, least, floor, short, joined
        self.strange = dict.fromkeys(formats, 0)

    def typical(self, word: str) -> dict[str, float]:
        """The log likelihood of each format of which the word is typical."""
        n, form = len(word), shape(word)
        fit = [k for k, a in self.formats.items() if n >= self.short[k] and a.shape.strange(form) <= self.strange[k]]
        return {k: x for k in fit if (x := self.formats[k].score(word)) >= self.floor[k] * (n + 1)}

    def none(self, word: str) -> float:
        """The log likelihood of the likeliest plain kind."""
        return max(a.score(word) for a in self.plain.values())

    def best(self, word: str) -> tuple[str | None, float]:
        """kind, and its log likelihood, or that of the likeliest plain kind where there is none."""
        none = self.none(word)
        return self._among(word, self.typical(word) if looks(word) else {}, none)

    def _among(self, word: str, own: dict[str, float], none: float) -> tuple[str | None, float]:
        most = {k: x for k, x in own.items() if (x - none) / (len(word) + 1) > self.least[k]}
        kind = max(most, key=lambda k: most[k] - self.least[k] * (len(word) + 1)) if most else None
        return kind, most[kind] if kind else none

    def kind(self, word: str) -> str | None:
        """The format of which the word is typical and that leads the likeliest plain kind by most, and by enough, a symbol;
        or None."""
        own = self.typical(word) if looks(word) else {}
        return self._among(word, own, self.none(word))[0] if own else None


def fit(secrets: dict[str, list[str]] | None = None, plain: dict[str, list[str]] | None = None) -> Model:
    """Half of the labelled words make the automata. The other half of the credentials sets what is typical of each format;
    the other half of the plain words, and their parts, the least lead: above that of each of them, and above 0.1."""
    if secrets is None or plain is None:
        secrets, plain = labelled()
    model = Model(*({k: Format(ws[::2]) for k, ws in of.items() if ws} for of in (secrets, plain)), {}, {}, {k: min(map(len, ws)) for k, ws in secrets.items() if ws}, {len(w) for ws in secrets.values() for w in ws if "/" in w})
    for k, a in model.formats.items():
        own = sorted(a.score(w) / (len(w) + 1) for w in secrets[k][1::2])
        model.floor[k] = (own[len(own) // 100] if own else 0.0) - 0.05
        model.strange[k] = max([0, *sorted(a.shape.strange(shape(w)) for w in secrets[k][1::2])[: len(own) - len(own) // 100]])
        model.least[k] = 0.1
    for word in (w[a:b] for ws in plain.values() for w in ws[1::2] for a, b in parts_of(w)):
        if own := model.typical(word):
            none = model.none(word)
            for k, x in own.items():
                model.least[k] = max(model.least[k], (x - none) / (len(word) + 1) + 0.02)
    return model


_model: list[Model] = []


def default_model() -> Model:
    if not _model:
        _model.append(fit())
    return _model[0]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def looks(word: str) -> bool:
    """Whether a word is scored at all: long enough, with a letter, and a digit or letters of either case."""
    return len(word) >= LEAST and any(map(str.isalpha, word)) and (any(map(str.isdigit, word)) or not (word.islower() or word.isupper()))


def windows_of(word: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, format) of the windows of a word over MOST that look like a credential. Windows begin every half of
    MOST, one more ends with the word, and what is left of the last whole MOST is one too; those that touch or overlap
    make one span, of the first one's format."""
    n, out = len(word), []
    for a, b in sorted({(at, min(n, at + MOST)) for at in range(0, n, MOST // 2)} | {(n - MOST, n)}):
        if looks(word[a:b]) and (kind := model.kind(word[a:b])):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
            else:
                out.append((a, b, kind))
    return out


def trimmed(word: str) -> tuple[int, int]:
    """Start and end of a word without the marks that may stand before and after a credential."""
    return len(word) - len(word.lstrip(EDGE)), len(word.rstrip(EDGE))


def cut(word: str, cuts: str) -> list[tuple[int, str]]:
    """(start, part) of a word between the first of the cuts that it has, or nothing if it has none."""
    c = next((c for c in cuts if c in word), None)
    if c is None:
        return []
    out, at = [], 0
    for part in word.split(c):
        out.append((at, part))
        at += len(part) + 1
    return out


def parts_of(word: str, cuts: str = CUTS) -> list[tuple[int, int]]:
    """All parts of a word that found_in may score, windows aside."""
    a, b = trimmed(word)
    if not looks(word[a:b]):
        return []
    return [(a, b), *((at + x, at + y) for at, part in cut(word, cuts) for x, y in parts_of(part, cuts))]


def read_parts(word: str, parts: list[tuple[int, str]], model: Model, cuts: str) -> tuple[list[tuple[int, int, str]], float]:
    """The likeliest reading of a word that is cut in parts: each part by itself, or some that follow each other as one
    credential, where their length is that of one with such marks inside."""
    best: list[tuple[float, int, list]] = [(0.0, 0, [])]  # for the first parts: likelihood, where its last step begins, that step's spans
    most = max(model.joined, default=0)
    for j, (at, part) in enumerate(parts):
        spans, x = found_in(part, model, cuts)
        step = (best[j][0] + x + MARK, j, [(at + a, at + b, k) for a, b, k in spans])
        end = at + len(part)
        for i in range(j - 1, -1, -1):
            n = end - parts[i][0]
            if n > most:
                break
            if n in model.joined and (kind := model.kind(one := word[parts[i][0] : end])):
                x = model.best(one)[1]
                if best[i][0] + x + MARK > step[0]:
                    step = (best[i][0] + x + MARK, i, [(parts[i][0], end, kind)])
        best.append(step)
    out, j = [], len(parts)
    while j:
        out, j = best[j][2] + out, best[j][1]
    return out, best[-1][0]


def found_in(word: str, model: Model, cuts: str = CUTS) -> tuple[list[tuple[int, int, str]], float]:
    """(start, end, format) of what looks like a credential in a candidate, and its log likelihood so read: the whole of
    it, without the marks that end a sentence, or what is found in its parts between `=`, those between `/`, and those
    between full stops, whichever is likelier; or else, where it is longer than MOST, its windows that do."""
    a, b = trimmed(word)
    if not looks(word[a:b]):
        return [], model.none(word) if word else 0.0
    parts = cut(word, cuts)
    out, total = read_parts(word, parts, model, cuts) if parts else ([], 0.0)
    ends = {(a, b), (a if word[:a].strip("+/") else 0, b if word[b:].strip("+/=") else len(word))}
    for x, y in sorted(ends):
        kind, like = model.best(word[x:y])
        like += MARK * (len(word) - (y - x))  # what is left out
        if kind and (not out or like + WHOLE * len(word) > total):
            out, total = [(x, y, kind)], like
        elif not parts and not out:
            total = like
    if not out and b - a > MOST and not parts:
        out = [(a + x, a + y, k) for x, y, k in windows_of(word[a:b], model)]
    return out, total


def more_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """(start, end, format) of other words that look like a credential; none overlaps a base span. Every run of
    candidate characters is scored, or what base spans leave of it on either side."""
    if max(map(len, text.split()), default=0) < LEAST:
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < LEAST:
            continue
        at = m.start()
        for a, b in [*((a, b) for a, b, _ in base if a < m.end() and m.start() < b), (m.end(), m.end())]:
            if a - at >= LEAST:
                out += [(at + x, at + y, kind) for x, y, kind in found_in(text[at:a], model)[0]]
            at = max(at, b)
    return out


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(text: str | None, model: Model) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of a text, by start, then kind in the order of KINDS, then formats."""
    text = text or ""
    base = base_spans(text)
    spans = [(*x, True) for x in base] + [(*x, False) for x in more_spans(text, base, model)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]) if x[3] else len(KINDS), x[2]))


def scan(docs: DataFrame, text: str = "text", model: Model | None = None, into: str = "secrets") -> DataFrame:
    """docs with secrets (or as `into` names it): an array of (start, end, kind, base), by start, then kind in the order of KINDS, then formats.

    Starts and ends are code points, the end exclusive. A null text is an empty one and has none. A column of docs named
    secrets is replaced. Rows are neither dropped nor merged; equal texts get equal spans. `model` comes from labelled
    examples only, so a document's spans don't depend on other documents."""
    docs = long_rows(docs).drop(*[c for c in docs.columns if c.lower() == into])
    at = docs.columns.index(text)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("base", BooleanType())])
    schema = StructType([*docs.schema.fields, StructField(into, ArrayType(span))])
    names = [f.name for f in schema]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    m = model or default_model()

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(at):
                out.append([{"start": a, "end": b, "kind": k, "base": f} for a, b, k, f in all_spans(t.as_py(), m)])
            yield pa.record_batch([*batch.columns, pa.array(out, arrow)], names)
        tidy()

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["base"])
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), F.size(F.filter("secrets", lambda s: ~s["base"])).cast("long").alias("n_more"))


def hidden(text: str | None, spans: list[tuple[int, int, str, bool]], mark: str) -> str | None:
    parts, end = [], 0
    for a, b, _, _ in spans:
        if a >= end:
            parts += [text[end:a], mark]
        end = max(end, b)
    return "".join([*parts, text[end:]]) if spans else text


def hide(docs: DataFrame, text: str = "text", mark: str = "[secret]", model: Model | None = None) -> DataFrame:
    """docs with every span of `scan` in the text replaced by `mark`, overlapping spans by one; all rows stay, and a
    null text stays null."""
    names, at = docs.columns, docs.columns.index(text)

    m = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [hidden(t, all_spans(t, m), mark) for t in (x.as_py() for x in batch.column(at))]
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)
        tidy()

    return long_rows(docs).mapInArrow(run, docs.schema)
