"""Secret scans: fixed patterns, and assignment-aware lexing.

The lexer cuts a text into strings (with prefixes, triple quotes and backquotes), names, flags, operators and line ends, and
reads name-value pairs from them: assignments (=, :=, =>, :), typed ones, subscripts (cfg["name"] = ..), keywords, tuples (a, b = ..), setters
(setName(".."), put("name", "..")), definitions (#define NAME ..), elements (<name>..</name>), blocks (name: | and lines farther in) and
flags (--name ..). It follows names to the literals they stand for, and scores a literal by the most sensitive name that receives
it and by the randomness of its own text or of the sum ("a" + "b", or of constants) that it is a part of, whichever is greater.
The patterns' spans stay as they are; the lexer's are added, under patterns' spans too.

A bare word counts on a line of its own (name, operator, word), after a flag, in an element or if it has a letter and a digit; so prose
isn't read as a pair. A quoted text with blanks counts where the name ends in password, passphrase, pwd or secret, it has three words or more, each of
four letters or not of letters only, and no name of a secret in it.

Work is linear in the text: a name is read once, and each name is followed at most once for each sensitivity.

Defined results: a null or empty text has no spans; equal spans of one kind are reported once; rows repeat as in the
input; offsets are code points, end exclusive; sums of over MOST_CHARS characters are judged term by term; a name that is
bound more than once stands for each of its literals, but isn't joined into sums; an f-string with a field in braces is no literal; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits is as long as can be, so asking for 24 at once finds the same runs as dropping shorter ones.
HEX = re.compile(r"[0-9a-f]{24,}")

#: How sensitive a name is, by what it contains.
NAMES = (
    (1.0, re.compile(r"passw(or)?d|passphrase|pwd|private_?key|secret|api_?key|access_?key|auth_?token|credential", re.IGNORECASE)),
    (0.8, re.compile(r"token|bearer|signing|client_?id_?key|encryption|salt|dsn|conn(ection)?_?str", re.IGNORECASE)),
)
#: Without one of these in its lower-cased text, no name above and no assignment can match; plain searches are much faster.
STEMS = ("passw", "passphrase", "pwd", "private", "secret", "api", "access", "auth", "credential", "token", "bearer", "signing", "client", "encryption", "salt", "dsn", "conn")
ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PLACEHOLDER = re.compile(r"^(x+|\*+|\.+|changeme|example|test|todo|none|null|true|false|your[_ -].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|env\..*)$", re.IGNORECASE)
#: A quoted text, its quotes and prefix included. A backslash takes the next character, inside and outside, so a quote that isn't closed is searched for once a line.
STRING = r"""(?:(?<![A-Za-z0-9_])[rRbBfFuU]{1,2}(?=["'])|(?<![A-Za-z0-9_])(?=')|(?=["`]))(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)"""
#: A name begins where no name goes on, and is taken whole, so no part of it is tried again.
TOKEN = re.compile(rf"""(?P<S>{STRING})|(?P<F>(?<![^\s"'`])--?(?=[A-Za-z])[\w$.-]++)|(?P<N>[A-Za-z_$][\w$.-]*+)|(?P<O>:=|=>|==|!=|<=|>=|[:=<>,()\[\]{{}}?+|#;&])|(?P<L>\n)|(?P<B>\\.?)|(?P<W>[^\s"'`#;,(){{}}\[\]+:=<>?|&\\]++)|(?P<Q>["'`])""")
TERM = re.compile(rf"""(?P<S>{STRING})|(?P<I>[A-Za-z_$][\w$.]*+(?![^\s"'`#;,(){{}}\[\]+=<>?|&]))|(?P<W>[^\s"'`#;,(){{}}\[\]+]++)""")
PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
BLANKS = re.compile(r"[ \t]*+")
QUOTES = re.compile(r"""[A-Za-z]{0,2}("{3}|'{3}|["'`])""")
FIELD = re.compile(r"\{[^{}]*\}")
KEY = re.compile(r"[A-Za-z_$][\w$. -]{0,99}$")
IDENT = re.compile(r"[A-Za-z_$][\w$.]*$")
SETTER = re.compile(r"(?:^|[._])(?:set|with|use|add)(?=[_A-Z])")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*+>")
BLOCK = re.compile(r"[ \t]*+[|>][+-]?[ \t]*+\n")
LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|$)")
BEFORE = re.compile(r"""[ \t]*+(?:(?:export|set|env|declare|const|let|var|final|static|-|\#|//|\*)[ \t]++)*["']?$""", re.IGNORECASE)
AFTER = re.compile(r"[ \t]*+(?:[,;][ \t]*+)?(?:#[^\n]*+|//[^\n]*+)?(?:\r?\n|$)")
TYPES = ("string", "str", "bytes", "text")
SPACED = re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret)$", re.IGNORECASE)
MOST_CHARS = 4096
LEAST_SCORE = 0.5


def phrase(s: str) -> bool:
    """Three words or more, none of them a short one of letters only, none a name of a secret: not a sentence, not a label."""
    words = s.split()
    return len(words) >= 3 and all(len(w) > 3 or not w.isalpha() for w in words) and not any(p.search(s) for _, p in NAMES)


def randomness(s: str, spaced: bool = False) -> float:
    """0 to 1: Shannon bits a character and length, none for placeholders and, but for phrases where they are asked for, for texts with blanks."""
    if len(s) < 6 or PLACEHOLDER.match(s) or (" " in s.strip() and not (spaced and phrase(s))):
        return 0.0
    n = len(s)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    classes = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * bits + 0.1 * (classes - 1) + min(n, 32) / 160)


def sensitivity(name: str) -> float:
    return max((w for w, p in NAMES if p.search(name)), default=0.0)


#: A term of an expression: its text, start, end, and how it is written: "quoted", "bare" (may be a name) or "word" (counts as a literal as it stands).
Term = tuple[str, int, int, str]


def quoted(text: str, a: int, b: int) -> Term:
    """A string token without prefix and quotes."""
    m = QUOTES.match(text, a, b)
    mark = len(m[1])
    inner = text[m.end() : b - mark]
    field = ("f" in m[0].lower() or m[1] == "`") and FIELD.search(inner)
    return ("", m.end(), b - mark, "quoted") if field else (inner, m.end(), b - mark, "quoted")


def terms_at(text: str, at: int) -> tuple[list[Term], int]:
    """The terms of the sum that begins at a place of a line, and where it ends."""
    out: list[Term] = []
    end = at
    at = BLANKS.match(text, at).end()
    while m := TERM.match(text, at):
        end = m.end()
        out.append(quoted(text, m.start(), end) if m["S"] else (m[0], m.start(), end, "bare"))
        if not (plus := PLUS.match(text, end)):
            break
        at = plus.end()
    return out, end


def alone(text: str, name: int, end: int) -> bool:
    """Does the pair fill its line?"""
    line = text.rfind("\n", max(0, name - 200), name) + 1
    return name - line < 200 and bool(BEFORE.match(text[line:name])) and bool(AFTER.match(text, end))


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def block_at(text: str, name: int, at: int) -> Term | None:
    """The lines farther in than the name's, after `name: |`."""
    if not (m := BLOCK.match(text, at)):
        return None
    line = text.rfind("\n", 0, name) + 1
    deep = len(LINE.match(text, line)[1])
    first, last, at = -1, -1, m.end()
    while at < len(text) and (x := LINE.match(text, at)):
        if x[2].strip() and len(x[1]) <= deep:
            break
        if x[2].strip():
            first, last = (x.start(2) if first < 0 else first), x.start(2) + len(x[2].rstrip())
        at = x.end()
    return ("".join(text[first:last].split()), first, last, "word") if first >= 0 else None


def pairs(text: str) -> Iterator[tuple[str, list[Term]]]:
    """The names of a text that receive a value, each with the terms of what it receives."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
    n = len(tokens)
    sign = lambda j: text[tokens[j][1] : tokens[j][2]] if j < n and tokens[j][0] == "O" else ""
    kind = lambda j: tokens[j][0] if j < n else ""
    word = lambda j: text[tokens[j][1] : tokens[j][2]]
    done = chain = 0  # values up to done are read; no tuple of names begins before token chain
    for i, (k, a, b) in enumerate(tokens):
        if a < done or k not in "SNFO":
            continue
        if k == "O":
            if text[a] == "<" and (m := ELEMENT.match(text, a)) and (value := m[2].strip()):
                start = m.start(2) + len(m[2]) - len(m[2].lstrip())
                yield m[1].rsplit(":", 1)[-1], [(value, start, start + len(value), "word")]
                done = m.end()
            continue
        if k == "S":
            name, key = quoted(text, a, b)[0], a
            if not KEY.match(name):
                continue
        else:
            name, key = text[a:b].lstrip("-"), a
        if k == "N" and sign(i + 1) == "(" and kind(i + 2) == "S":
            first, c = quoted(text, *tokens[i + 2][1:]), sign(i + 3)
            if c == ")" and SETTER.search(name):
                yield name, [first]
            elif c == "," and kind(i + 4) == "S" and sign(i + 5) in (")", ",") and KEY.match(first[0]):
                yield first[0], [quoted(text, *tokens[i + 4][1:])]
            continue
        if k == "N" and name == "define" and i and sign(i - 1) == "#" and kind(i + 1) == "N":
            got, done = terms_at(text, tokens[i + 1][2])
            yield word(i + 1), [(t, x, y, "word" if how == "bare" and not IDENT.match(t) else how) for t, x, y, how in got]
            continue
        j = i + 1
        if k == "S" and i and sign(i - 1) == "[" and sign(j) == "]":
            j += 1
        elif k == "N" and sign(j) == "," and i >= chain:
            names = [name]
            while sign(j) == "," and kind(j + 1) == "N":
                names.append(word(j + 1))
                j += 2
            chain = j
            if sign(j) == "=":
                values, at = [], tokens[j][2]
                while len(values) < len(names):
                    got, at = terms_at(text, at)
                    values.append(got)
                    at = BLANKS.match(text, at).end()
                    if not got or text[at : at + 1] != ",":
                        break
                    at += 1
                if len(values) == len(names):
                    yield from ((x, v) for x, v in zip(names, values, strict=True) if v)
                    done = at
            continue
        elif k == "N" and kind(j) == "Q":
            j += 1  # a key whose opening quote is lost
        if k == "N" and sign(j) == ":" and kind(j + 1) == "N":  # name: type = ..
            t = j + 2
            if sign(t) == "<":
                while t < min(n, j + 12) and sign(t) != ">" and kind(t) != "L":
                    t += 1
                t += 1
            elif sign(t) == "[" and sign(t + 1) == "]":
                t += 2
            t += sign(t) == "?"
            j = t if sign(t) == "=" else j
        elif k == "N" and kind(j) == "N" and word(j) in TYPES and sign(j + 1) == "=":
            j += 1
        if sign(j) in ("=", ":=", "=>", ":"):
            if sign(j) == ":" and (block := block_at(text, key, tokens[j][2])):
                yield name, [block]
                done = block[2]
                continue
            got, end = terms_at(text, tokens[j][2])
        elif k == "F" and j < n and text[a : a + 2] == "--" and kind(j) in ("N", "W", "S"):
            got, end = terms_at(text, b)
        else:
            continue
        if not got:
            continue
        sure = k == "F" or any(how == "bare" for *_, how in got) and alone(text, key, end)
        yield name, [(t, x, y, how if how == "quoted" or IDENT.match(t) and not (sure or mixed(t)) else "word" if not IDENT.match(t) and (sure or mixed(t)) else "sure" if sure or mixed(t) else how) for t, x, y, how in got]
        done = end


class Bindings:
    """The expressions that names of one text are bound to. An expression is a list of terms: (value, None, start, end) or (None, name, start, end); both are None for a bare word of prose."""

    def __init__(self, text: str):
        self.exprs: list[list[tuple[str | None, str | None, int, int]]] = []
        self.of: dict[str, list[int]] = {}
        raw = []
        for name, terms in pairs(text):
            raw.append(terms)
            self.of.setdefault(name, []).append(len(raw) - 1)
        for terms in raw:
            self.exprs.append([(t, None, a, b) if how in ("quoted", "word") else (None, t, a, b) if t in self.of else (t if how == "sure" else None, None, a, b) for t, a, b, how in terms])
        self.values: dict[int, str | None] = {}

    def value(self, i: int) -> str | None:
        """The text that expression i stands for; None if a term is unknown, bound more than once, bound to itself, or the text is too long."""
        stack, open_ = [i], set()
        while stack:
            j = stack[-1]
            if j in self.values:
                stack.pop()
                continue
            inner = [self.of[n][0] if len(self.of[n]) == 1 else -1 for _, n, _, _ in self.exprs[j] if n is not None]
            ahead = [] if j in open_ else [k for k in inner if k >= 0 and k not in self.values and k not in open_]
            open_.add(j)
            if ahead:
                stack += ahead
                continue
            parts = [v if n is None else self.values.get(self.of[n][0]) if len(self.of[n]) == 1 else None for v, n, _, _ in self.exprs[j]]
            known = all(x is not None for x in parts) and sum(map(len, parts)) <= MOST_CHARS
            self.values[j] = "".join(parts) if known else None
            stack.pop()
        return self.values[i]


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    names = Bindings(text)
    found: dict[tuple[int, int], float] = {}
    for level in sorted({w for w, _ in NAMES}, reverse=True):
        todo = [(n, 0.0, bool(SPACED.search(n))) for n in names.of if sensitivity(n) == level]
        seen: set[tuple[str, bool, bool]] = set()  # a name is followed again only if a sum that it belongs to is what scores, or where phrases count
        while todo:
            name, above, spaced = todo.pop()
            if (name, level * above >= LEAST_SCORE, spaced) in seen:
                continue
            seen.add((name, level * above >= LEAST_SCORE, spaced))
            for i in names.of[name]:
                terms = names.exprs[i]
                whole = max(above, randomness(names.value(i) or "", spaced)) if len(terms) > 1 else above
                for value, inner, a, b in terms:
                    if inner is not None:
                        todo.append((inner, whole, spaced))
                    elif value is not None and b > a and (score := level * max(whole, randomness(value, spaced))) >= LEAST_SCORE:
                        found[a, b] = max(found.get((a, b), 0.0), score)
    return [(a, b, s) for (a, b), s in found.items()]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(x in low for x in ASSIGN_STEMS):
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans, and all spans; both in order of start, then kind."""
    text = text or ""
    base = base_spans(text)
    low = text.lower()
    more = lexed(text) if any(x in low for x in STEMS) and any(p.search(text) for _, p in NAMES) else []
    added = [("lexed", a, b) for a, b, _ in more]
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, kinds' counts, base_sha256 and spans (kind:start:end, comma-joined)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS[:3]]
            sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_joined(x) for _, x in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(each, out)
