"""Secret scan by one deterministic automaton for all rules.

Rules are regular expressions over bytes. Each is parsed to a nondeterministic
automaton; all rules together, read backwards and started at every byte, are
determinised by subset construction and minimised by partition refinement to
transition arrays. One pass over a text's bytes, from the last to the first,
then tells at each byte which rules have a match that starts there. From the
leftmost start a rule's own (anchored, minimised) automaton finds the longest
end, and the rule goes on behind it: leftmost-longest, non-overlapping matches of
each rule. For the rules here that equals a backtracking engine's result.

A rule may ask for a least length of its match or of the value in it; shorter
matches are dropped after matching, and still use up their text. (Lengths are not
written as counted repeats: the counters of several rules would multiply in the
subset construction.)

Null texts are empty; an empty text has no span. Equal rows are scanned one by
one; other columns are ignored. A text of any length takes memory in proportion
to its own size only.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cached, mapped, texts


@dataclass(frozen=True)
class Rule:
    """kind: the name in spans. least: least bytes of a match, or with `value` of what follows its first : or =, spaces and a quote."""

    kind: str
    pattern: str
    least: int = 0
    value: bool = False
    ignore_case: bool = False


#: The rules whose spans the digest contract fixes.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further well-known credential shapes.
MORE = (
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE


# Patterns -> trees. Trees: ("set", frozenset of bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None).


class _Parser:
    def __init__(self, text: str, fold: bool):
        self.s, self.i, self.fold = text.encode(), 0, fold

    def end(self) -> bool:
        return self.i >= len(self.s)

    def byte(self) -> int:
        b = self.s[self.i]
        self.i += 1
        if b == 0x5C:
            b = self.s[self.i]
            self.i += 1
            if b == ord("x"):
                b = int(self.s[self.i : self.i + 2], 16)
                self.i += 2
        return b

    def chars(self, found: set) -> frozenset:
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return frozenset(found)

    def set_body(self, stop: int | None) -> set:
        found: set[int] = set()
        while not self.end() and self.s[self.i] != stop:
            a = self.byte()
            if not self.end() and self.s[self.i] == ord("-") and self.i + 1 < len(self.s) and self.s[self.i + 1] != stop:
                self.i += 1
                found |= set(range(a, self.byte() + 1))
            else:
                found.add(a)
        return found

    def atom(self):
        b = self.s[self.i]
        if b == ord("("):
            self.i += 1
            t = self.alt()
            self.i += 1
            return t
        if b == ord("["):
            self.i += 1
            found = self.set_body(ord("]"))
            self.i += 1
            return ("set", self.chars(found))
        return ("set", self.chars({self.byte()}))

    def cat(self):
        parts = []
        while not self.end() and self.s[self.i] not in b"|)":
            t = self.atom()
            while not self.end() and self.s[self.i] in b"*+?{":
                op = chr(self.s[self.i])
                self.i += 1
                if op == "{":
                    close = self.s.index(b"}", self.i)
                    low, _, high = self.s[self.i : close].decode().partition(",")
                    most = int(low) if b"," not in self.s[self.i : close] else int(high) if high else None
                    self.i = close + 1
                    t = ("rep", t, int(low), most)
                else:
                    t = ("rep", t, int(op == "+"), 1 if op == "?" else None)
            parts.append(t)
        return ("cat", parts)

    def alt(self):
        parts = [self.cat()]
        while not self.end() and self.s[self.i] == ord("|"):
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)


def mirrored(t):
    """The tree of the reversed strings."""
    if t[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(t[1])])
    if t[0] == "alt":
        return ("alt", [mirrored(x) for x in t[1]])
    return ("rep", mirrored(t[1]), *t[2:]) if t[0] == "rep" else t


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, t, at: int) -> int:
        """The state behind tree t entered at `at`."""
        if t[0] == "set":
            to = self.state()
            mid = self.state()
            self.empty[at].append(mid)
            self.step[mid] = (t[1], to)
            return to
        if t[0] == "cat":
            for x in t[1]:
                at = self.add(x, at)
            return at
        if t[0] == "alt":
            to = self.state()
            for x in t[1]:
                self.empty[self.add(x, at)].append(to)
            return to
        _, x, least, most = t
        for _ in range(least):
            at = self.add(x, at)
        if most is None:
            hub, to = self.state(), self.state()
            self.empty[at].append(hub)
            self.empty[self.add(x, hub)].append(hub)
            self.empty[hub].append(to)
            return to
        to = self.state()
        self.empty[at].append(to)
        for _ in range(most - least):
            at = self.add(x, at)
            self.empty[at].append(to)
        return to

    def closed(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """classes: byte to byte class. rows[state][class] is the next state; states from `first` on accept marks[state] (a bit for each rule); `dead` leads nowhere, or is -1."""

    classes: bytes
    rows: list[list[int]]
    start: int
    first: int
    marks: list[int]
    dead: int


def compiled(rules, trees, everywhere: bool) -> Automaton:
    """Subset construction, then minimisation. everywhere: a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, t in enumerate(trees):
        ends[nfa.add(t, root)] = 1 << k
    # Bytes that no set tells apart share a class.
    sets = list({s[0] for s in nfa.step if s})
    looks = [tuple(b in x for x in sets) for b in range(256)]
    kinds = {look: k for k, look in enumerate(dict.fromkeys(looks))}
    classes = bytes(kinds[x] for x in looks)
    sample = [looks.index(x) for x in kinds]
    begin = nfa.closed([root])
    ids, todo, rows, marks = {begin: 0}, [begin], [], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            to = {nfa.step[x][1] for x in now if nfa.step[x] and b in nfa.step[x][0]}
            nxt = nfa.closed(to | ({root} if everywhere else set()))
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
        marks.append(sum(ends.get(x, 0) for x in now))
    # Partition refinement: split by what the classes lead to, until nothing splits.
    block = [sorted(set(marks)).index(m) for m in marks]
    while True:
        looks = [(block[s], *(block[x] for x in rows[s])) for s in range(len(rows))]
        names = {look: k for k, look in enumerate(dict.fromkeys(looks))}
        new = [names[x] for x in looks]
        if len(names) == len(set(block)):
            break
        block = new
    # Accepting states come last, so that one comparison finds them.
    reps: dict[int, int] = {}
    for s, k in enumerate(block):
        reps.setdefault(k, s)
    order = sorted(reps, key=lambda k: (marks[reps[k]] != 0, k))
    name = {k: i for i, k in enumerate(order)}
    table = [[name[block[x]] for x in rows[reps[k]]] for k in order]
    out_marks = [marks[reps[k]] for k in order]
    first = next((i for i, m in enumerate(out_marks) if m), len(order))
    dead = next((i for i, r in enumerate(table) if not out_marks[i] and all(x == i for x in r)), -1)
    return Automaton(classes, table, name[block[0]], first, out_marks, dead)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        trees = [_Parser(r.pattern, r.ignore_case).alt() for r in rules]
        self.starts = compiled(rules, [mirrored(t) for t in trees], True)
        self.ends = [compiled([r], [t], False) for r, t in zip(rules, trees, strict=True)]

    def hits(self, data: bytes) -> tuple[array, array]:
        """Where runs of bytes begin, from the last to the first, at each of which the same rules have a match that starts there; and the bits of those rules, 0 for none. A run of any length is one entry."""
        a = self.starts
        rows, s, first, marks = a.rows, a.start, a.first, a.marks
        at, bits, last, n = array("q"), array("q"), 0, len(data) - 1
        for k, c in enumerate(data[::-1].translate(a.classes)):
            s = rows[s][c]
            now = marks[s] if s >= first else 0
            if now != last:
                at.append(n - k)
                bits.append(now)
                last = now
        return at, bits

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        found, behind = [], [0] * len(self.rules)
        tops, rules = self.hits(data)
        low = 0
        # Run i holds its first byte and those below it, down to the next run's.
        for i in range(len(tops) - 1, -1, -1):
            low, high = (tops[i + 1] + 1 if i + 1 < len(tops) else 0), tops[i]
            bits, k = rules[i], 0
            while bits:
                if bits & 1:
                    at = max(low, behind[k])
                    while at <= high:
                        end = self.longest(k, data, at)
                        rule = self.rules[k]
                        if (self.value(data, at, end) if rule.value else end - at) >= rule.least:
                            found.append((at, k, end))
                        behind[k] = at = max(end, at + 1)
                bits >>= 1
                k += 1
        found.sort()
        return found

    def longest(self, k: int, data: bytes, at: int) -> int:
        a = self.ends[k]
        rows, s, classes, end = a.rows, a.start, a.classes, at
        for i in range(at, len(data)):
            s = rows[s][classes[data[i]]]
            if s == a.dead:
                break
            if s >= a.first:
                end = i + 1
        return end

    @staticmethod
    def value(data: bytes, at: int, end: int) -> int:
        """Bytes behind the first : or = of a match, less spaces and a quote."""
        body = data[at:end]
        rest = body[min(x for x in (body.find(b":"), body.find(b"=")) if x >= 0) + 1 :].lstrip(b" ")
        return len(rest) - (rest[:1] in (b'"', b"'"))


def in_characters(text: str, data: bytes, spans) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if len(text) == len(data):
        return spans
    out, at, count, known = [], 0, 0, {}
    for x in sorted({x for s in spans for x in (s[0], s[2])}):
        count += len(data[at:x].decode("utf-8", "ignore"))
        at = x
        known[x] = count
    for s, k, e in spans:
        out.append((known[s], k, known[e]))
    return out


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end>> (code points, end exclusive; by start, then in the rules' order) of each row."""

    def run(batches):
        scanner = cached(("secrets", rules), lambda: Scanner(rules))
        kinds = [r.kind for r in rules]
        for b in batches:
            out = []
            for t in texts(b):
                data = t.encode()
                out.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in in_characters(t, data, scanner.spans(data))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(mapped, run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", with_mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of the text (overlapping ones joined) replaced by the mark. Null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        scanner = cached(("secrets", rules), lambda: Scanner(rules))
        mark = with_mark.encode()
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                data = (t or "").encode()
                spans = scanner.spans(data)
                if not spans:
                    out.append(t)
                    continue
                parts, behind = [], 0
                for s, _, e in spans:
                    if s >= behind:
                        parts += [data[behind:s], mark]
                    behind = max(behind, e)
                parts.append(data[behind:])
                out.append(b"".join(parts).decode())
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.transform(mapped, run, docs.schema)
