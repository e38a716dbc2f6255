"""Secret scans: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base scan; ASCII letters of the names match in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
# What ends before an operator: a name with a quote or bracket after it, a name with array bounds, a size of a type.
NAME = re.compile(r"([A-Za-z_$][A-Za-z0-9_$.\-]{0,127})[\"'\]]{0,2}[?!]?\Z")
ARRAY = re.compile(r"([A-Za-z_$][A-Za-z0-9_$.\-]{0,127})(?:\[[A-Za-z0-9_ \t+*]{0,60}\])+\Z")
SIZE = re.compile(r"\([0-9, ]{1,20}\)\Z")
# What stands before the word of a type that follows its name (`var name *string = `), and such words.
TYPE_PREFIX = re.compile(r"(?:\[[0-9.]{0,20}\]|[*&])+\Z")
TYPE_WORDS = frozenset("string str text char nchar varchar nvarchar varchar2 nvarchar2 byte bytes rune any".split())
OPERATOR = re.compile(r":=|=>|==|[:=]")
# A type between `name:` and `=`: words with brackets of up to three levels, joined by `|`.
BRACKETS = "|".join(
    rf"{o}(?:[^{o}{c}\n]|{o}(?:[^{o}{c}\n]|{o}[^{o}{c}\n]*+{c})*+{c})*+{c}" for o, c in ((r"\[", r"\]"), ("<", ">"), (r"\(", r"\)"))
)
TYPE = rf"(?:(?:[&*]|\[[0-9]*+\]|'\w++[ \t]|(?:mut|const|dyn|readonly|unique)[ \t])[ \t]*+)*+[A-Za-z_$](?:[\w$.]|::)*+(?:{BRACKETS})*+[?!*&]*+"
ANNOTATION = re.compile(rf"[ \t]*+{TYPE}(?:[ \t]*+\|[ \t]*+{TYPE})*+[ \t]*+=(?![=>~])", re.A)
OPENING = re.compile(r"[ \t]*+((?:[(\[{][ \t\r\n]*+)*+)")
QUOTED = re.compile(r"(?:[rRbBuUfFL@$]{1,2}(?=[\"']))?(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)")
# A bare value ends at white space, punctuation and `&`; it takes four stretches between `:` or `=` at most, as each of those
# may begin a value of its own, and the padding of encoded bytes.
BARE = re.compile(r"(?:[:=]*+[^\s\"'`,;(){}\[\]<>&:=]++){1,4}+={0,2}+")
BARE_GOES_ON = re.compile(r"[^\s\"'`,;(){}\[\]<>&]")
WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+")
# What joins two parts of a value, and literals side by side; within brackets lines may break anywhere.
JOIN = re.compile(r"(?:[ \t]*+(?:\\?\r?\n[ \t]++)?)(?:\+|&|\|\||\.\.?(?=[ \t]*+[\"'$]))[ \t]*+(?:\\?\r?\n[ \t]*+)?(?=[A-Za-z_$@\"'`])")
BESIDE = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?(?=[rRbBuUfFL@$]{0,2}[\"'])")
BESIDE_INSIDE = re.compile(r"[ \t\r\n]*+(?=[rRbBuUfFL@$]{0,2}[\"'])")
NEXT = re.compile(r"[ \t\r\n]*+,[ \t\r\n]*+")
KEY_END = re.compile(r"[ \t]*+(?::|=)")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Words of target names and how sensitive each is.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "private": 1.5, "auth": 1.5, "bearer": 2.0, "signature": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "client": 0.5,
    "session": 1.0, "salt": 1.5, "license": 0.5,
}
SCORE = 4.5
MIN_LENGTH = 8
SPANS = "array<struct<kind: string, start: long, end: long>>"


def sensitivity(name: str) -> float:
    """The sum over the distinct words of a target name (`dbPassword`, `API_KEY`, `auth.token`)."""
    return sum(SENSITIVE.get(p, 0.0) for p in {p.lower() for p in NAME_PART.findall(name)})


def literal_weight(value: str) -> float:
    """0 for what cannot be a secret; else up to 3, by length and by the entropy of its characters."""
    if len(value) < MIN_LENGTH or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = bool(re.search("[0-9]", value)) + bool(re.search("[A-Za-z]", value))
    return min(entropy, 4.0) / 2 + 0.5 * mixed


def skip_blanks_back(text: str, at: int) -> int:
    while at and text[at - 1] in " \t":
        at -= 1
    return at


def names_before(text: str, at: int) -> list[str]:
    """The names that what follows the operator at `at` may belong to.

    The word before the operator; the array before its bounds (`name[] =`); and the
    word before a type that stands behind its name (`var name string =`,
    `name varchar(50) =`, `name As String =`).
    """
    at = skip_blanks_back(text, at)
    if text[at - 1 : at] == ")" and (size := SIZE.search(text, max(0, at - 24), at)):
        at = skip_blanks_back(text, size.start())
    near = NAME.search(text, max(0, at - 150), at)
    array = ARRAY.search(text, max(0, at - 300), at) if text[at - 1 : at] == "]" else None
    names = [m[1] for m in (near, array) if m]
    if near:
        prefix = TYPE_PREFIX.search(text, max(0, near.start() - 24), near.start())
        start = prefix.start() if prefix else near.start()
        end = skip_blanks_back(text, start)
        before = NAME.search(text, max(0, end - 150), end) if end < start else None
        if before and before[1].lower() == "as":
            end = skip_blanks_back(text, before.start())
            before = NAME.search(text, max(0, end - 150), end)
        if before:
            end = skip_blanks_back(text, before.start())
            keyword = text[max(0, end - 5) : end]
            is_type = near[1].lower() in TYPE_WORDS
            if is_type or keyword.endswith("var") or keyword == "const" and before[1].lower() not in TYPE_WORDS:
                names.append(before[1])
    return names


# A literal with its place.
Literal = tuple[str, int, int]
CODES = 128
# Above this a count of characters is scaled down: what a name joined to itself again and again stands for.
MANY = 1e100


class Node:
    """Literals that a value is joined of, and the nodes of constants in it, which many values may share.

    `told`: all its literals are reported. `walked`: the highest sensitivity for which its literals were looked at
    one by one. Either way a node is walked once, however many names it reaches.
    """

    __slots__ = ("parts", "told", "walked")

    def __init__(self, parts: list[Literal | Node]):
        self.parts, self.told, self.walked = parts, False, 0.0


class Value:
    """What a name stands for: its literals without white space, how many characters of each kind they have in all, the best single one."""

    __slots__ = ("node", "n", "counts", "best", "single")

    def __init__(self, parts: list[Literal | Value]):
        # What has white space is no part of a secret.
        kept = [p for p in parts if isinstance(p, Value) or p[0] and not re.search(r"\s", p[0])]
        self.node = Node([p.node if isinstance(p, Value) else p for p in kept])
        self.single = kept[0][0] if len(kept) == 1 and not isinstance(kept[0], Value) else None
        self.n, self.counts, self.best = None, None, 0.0
        if any(isinstance(p, Value) for p in kept):
            # Constants are measured when they become part of another value: one step deep, however long the chain.
            self._measure(kept)

    def _measure(self, parts: list[Literal | Value]) -> None:
        self.n, self.counts = 0.0, np.zeros(CODES, np.float64)
        for part in parts:
            if isinstance(part, Value):
                part.measured()
                self.n, self.counts, self.best = self.n + part.n, self.counts + part.counts, max(self.best, part.best)
            else:
                codes = np.frombuffer(part[0].encode("utf-32-le", "surrogatepass"), np.uint32)
                self.n += len(codes)
                self.counts += np.bincount(np.where(codes < CODES, codes, codes % 32), minlength=CODES)
                self.best = max(self.best, literal_weight(part[0]))
        if self.n > MANY:
            self.n, self.counts = self.n / MANY, self.counts / MANY

    def measured(self) -> Value:
        if self.n is None:
            self._measure(self.node.parts)
        return self

    def weight(self) -> float:
        """`literal_weight` of all literals joined."""
        if self.single is not None:
            return literal_weight(self.single)
        self.measured()
        if self.n < MIN_LENGTH:
            return 0.0
        share = self.counts[self.counts > 0] / self.n
        mixed = bool(self.counts[48:58].any()) + bool(self.counts[65:91].any() or self.counts[97:123].any())
        return min(float(-(share * np.log2(share)).sum()), 4.0) / 2 + 0.5 * mixed


def joined_parts(text: str, at: int, inside: str, constants: dict[str, Value]) -> tuple[list[Literal | Value] | None, int]:
    """The literals that one value at `at` is joined of, constants as their values, and where it ends.

    None where there is no value. A bare word that is no constant stands for
    itself, if nothing else is joined to it.
    """
    parts, seen, first = [], False, at
    while True:
        if term := QUOTED.match(text, at):
            group = term.lastindex
            if inside == "{" and KEY_END.match(text, term.end()):
                return None, term.end()
            parts.append((term[group], term.start(group), term.end(group)))
            seen = True
        elif term := WORD.match(text, at):
            whole = BARE_GOES_ON.match(text, term.end()) is None
            # A joined word before an operator is the next statement's name.
            if (whole or JOIN.match(text, term.end())) and term[0] in constants and (at == first or not KEY_END.match(text, term.end())):
                parts.append(constants[term[0]])
                seen = True
            elif not whole and not JOIN.match(text, term.end()):
                break
        else:
            break
        at = term.end()
        beside = (BESIDE_INSIDE if inside else BESIDE).match(text, at) if text[at - 1] in "\"'`" else None
        if not (more := beside or JOIN.match(text, at)):
            break
        at = more.end()
    if seen:
        return parts, at
    bare = BARE.match(text, first)
    if bare is None:
        return None, first
    # Within brackets a bare word is rather a name, a key or a call.
    if inside and not (inside != "{" and text[bare.end() : bare.end() + 1] in (")", "]") and re.search("[0-9]", bare[0])):
        return [], bare.end()
    return [(bare[0], bare.start(), bare.end())], bare.end()


def assignments(text: str) -> Iterator[tuple[str, str, Value]]:
    """(name, its own literals joined, value) of each assignment-like place, left to right.

    Covers `name = value`, `name: value`, `"name": "value"`, `name := value`,
    `name => value`, `name: type = value`, `name type = value` and `name[] = value`,
    with values quoted or bare (see BARE), in brackets (each element of a list is a
    value), and joined of literals and constants. A bare identifier stands for
    the literals last assigned to it above. A comparison is no assignment, nor is `::`.

    Limits: of a name the last 128 characters count, array bounds and types may
    have 60 and 24, brackets of a type three levels. Work and memory are linear in the text: values share what
    constants stand for.
    """
    constants: dict[str, Value] = {}
    for op in OPERATOR.finditer(text):
        if op[0] == "==" or text[op.start() - 1 : op.start()] in ("!", "<", ">") or op[0] == ":" and text[op.end() : op.end() + 1] == ":":
            continue
        if not (names := names_before(text, op.start())):
            continue
        typed = ANNOTATION.match(text, op.end()) if op[0] == ":" else None
        opening = OPENING.match(text, typed.end() if typed else op.end())
        inside, at, values = opening[1].strip()[-1:], opening.end(), []
        while True:
            parts, at = joined_parts(text, at, inside, constants)
            if parts:
                values.append((parts, Value(parts)))
            after = NEXT.match(text, at) if inside and parts is not None else None
            if not after:
                break
            at = after.end()
        if values:
            constant = values[0][1] if len(values) == 1 else Value([v for _, v in values])
            for name in names:
                constants[name] = constant
                for parts, value in values:
                    yield name, "".join(p[0] for p in parts if isinstance(p, tuple)), value


def _tell(node: Node, found: set[tuple[int, int]]) -> None:
    """All literals of a node."""
    rest = [node]
    while rest:
        if not (now := rest.pop()).told:
            now.told = True
            found.update(p[1:] for p in now.parts if isinstance(p, tuple))
            rest.extend(p for p in now.parts if not isinstance(p, tuple))
            # All is said: what only this node holds can go.
            now.parts = []


def _tell_single(node: Node, weight: float, threshold: float, found: set[tuple[int, int]]) -> None:
    """Those literals of a node that suffice one by one."""
    rest = [node]
    while rest:
        if not (now := rest.pop()).told and weight > now.walked:
            now.walked = weight
            for part in now.parts:
                if not isinstance(part, tuple):
                    rest.append(part)
                elif (one := literal_weight(part[0])) and weight + one >= threshold:
                    found.add(part[1:])


def lexed_spans(text: str, threshold: float = SCORE) -> list[tuple[int, int]]:
    """Places of literals that reach sensitive names, directly, joined or through constants.

    The literals' own places are reported, since those have to go. Of joined
    literals those without white space are weighed together and each alone.
    """
    found: set[tuple[int, int]] = set()
    for name, _, value in assignments(text):
        if not (weight := sensitivity(name)) or value.node.told:
            continue
        own = value.weight()
        if own and weight + own >= threshold:
            _tell(value.node, found)
        elif value.single is None and value.best and weight + value.best >= threshold:
            _tell_single(value.node, weight, threshold, found)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns' matches."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, threshold: float = SCORE) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, found).

    `spans` lists kind:start:end of all spans by start, then kind, in code points
    with exclusive end; `found` has the same as an array of structs; the digest
    covers the spans of the fixed patterns only. A null or empty text has none.
    Each row is treated alone: equal or null ids are kept, other columns ignored.
    """
    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {SPANS}"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list, ...] = ([], [], [])
            digests, spans, found = [], [], []
            for text in (t.as_py() for t in batch.column(1)):
                base = base_spans(text) if text else []
                for k, column in enumerate(counts):
                    column.append(sum(b[1] == k for b in base))
                every = sorted(base + [(s, 3, e) for s, e in lexed_spans(text, threshold)]) if text else []
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def redact(text: str, threshold: float = SCORE, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by `mark`."""
    spans = sorted([(s, e) for s, _, e in base_spans(text)] + lexed_spans(text, threshold))
    out, at, last = [], 0, -1
    for start, end in spans:
        if start >= last:
            out += [text[at:start], mark]
        last = max(last, end)
        at = last
    return "".join([*out, text[at:]]) if spans else text


def redact_documents(docs: DataFrame, threshold: float = SCORE) -> DataFrame:
    """The same rows and columns, secrets in `text` replaced; null texts stay null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([redact(t, threshold) if t else t for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(apply, docs.schema)
