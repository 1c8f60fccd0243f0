"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

Each rule's expression becomes a non-deterministic automaton over bytes. The subset construction runs all of them
side by side, each as a scanner of leftmost, longest, non-overlapping matches: its threads stand in the order of
their starts, those behind an accepting one go, and when the accepting one dies the rule has found a match and
begins anew. The joint states are minimised, bytes that no state tells apart share a class, and what is left is one
transition array. Runs of text between bytes that bring every state back to the start are scanned side by side. A
match's start comes from its rule's reversed automaton, run back from the end; only ends that lie far enough behind
the rule's last one can be matches of the asked length, so prose costs nothing there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.llm.common import row_chunks, tidy, utf8

#: Bytes scanned together, or one longer text, and bytes after which a run may end.
BATCH_BYTES, RUN_BYTES = 2 << 20, 1 << 10
#: With fewer runs than this under way, each goes on alone.
FEW_RUNS = 24
#: Never in a text in UTF-8: it stands behind each one.
END = 0xFF
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``head`` and ``value`` are the two parts of its expression (literals, classes, ``\\xHH``, groups,
    ``|``, ``?``, ``*``, ``+``, ``{m}``; ``any_case`` holds for ASCII letters). A match counts if it has ``least``
    characters and its value ``least_value``."""

    kind: str
    head: str
    value: str
    least: int = 1
    least_value: int = 1
    any_case: bool = False


# The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_value=8, any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", least=16),
    Rule("hex", r"", r"[0-9a-f]+", least=32),
)
#: What the method adds: private keys, signed web tokens, keys of chat and code hosts.
MORE = (
    Rule("pem", r"-----BEGIN\x20", r"[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", least=40),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]+", least=24),
    Rule("code", r"gh[oprsu]_", r"[A-Za-z0-9]+", least=40),
)
RULES = BASE + MORE


class Nfa:
    """States with byte sets and empty moves, made from an expression by recursive descent."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[np.ndarray, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def build(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.pattern, self.at, self.any_case = pattern, 0, any_case
        ends = self._either()
        if self.at < len(pattern):
            raise ValueError(f"not an expression: {pattern[self.at :]}")
        return ends

    def _more(self, marks: str) -> bool:
        return self.at < len(self.pattern) and self.pattern[self.at] in marks

    def _either(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, z = self._chain()
            self.empty[first].append(a)
            self.empty[z].append(last)
            if not self._more("|"):
                return first, last
            self.at += 1

    def _chain(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.pattern) and not self._more("|)"):
            begin = self.at
            a, z = self._atom()
            times = 1
            if self._more("{"):
                stop = self.pattern.index("}", self.at)
                times, after = int(self.pattern[self.at + 1 : stop]), stop + 1
                for _ in range(times - 1):
                    self.at = begin
                    b, y = self._atom()
                    self.empty[z].append(b)
                    z = y
                self.at = after
            if self._more("?*+"):
                mark = self.pattern[self.at]
                self.at += 1
                if mark != "+":
                    self.empty[a].append(z)
                if mark != "?":
                    self.empty[z].append(a)
            self.empty[last].append(a)
            last = self.state()
            self.empty[z].append(last)
        return first, last

    def _atom(self) -> tuple[int, int]:
        if self._more("("):
            self.at += 1
            ends = self._either()
            self.at += 1
            return ends
        first, last = self.state(), self.state()
        self.moves[first].append((self._bytes(), last))
        return first, last

    def _bytes(self) -> np.ndarray:
        out = np.zeros(256, bool)
        if self._more("["):
            self.at += 1
            while not self._more("]"):
                low = high = self._byte()
                if self._more("-") and self.pattern[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte()
                out[low : high + 1] = True
            self.at += 1
        else:
            out[self._byte()] = True
        if self.any_case:
            out[65:91] |= out[97:123]
            out[97:123] |= out[65:91]
        return out

    def _byte(self) -> int:
        char = self.pattern[self.at]
        self.at += 1
        if char == "\\":
            char = self.pattern[self.at]
            self.at += 1
            if char == "x":
                self.at += 2
                return int(self.pattern[self.at - 2 : self.at], 16)
        if ord(char) > 127:
            raise ValueError("expressions are ASCII")
        return ord(char)

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in found:
                found.add(s)
                todo.extend(self.empty[s])
        return frozenset(found)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed(t for s in states for some, t in self.moves[s] if some[byte])

    def reversed(self) -> Nfa:
        back = Nfa()
        for _ in self.moves:
            back.state()
        for s, (moves, empty) in enumerate(zip(self.moves, self.empty)):
            for some, t in moves:
                back.moves[t].append((some, s))
            for t in empty:
                back.empty[t].append(s)
        return back


def classes_of(nfas: Iterable[Nfa]) -> np.ndarray:
    """A class for each byte: bytes that no move of any automaton tells apart share one."""
    sets = [some for nfa in nfas for moves in nfa.moves for some, _ in moves]
    table = np.array([*sets, np.arange(256) == END]).T
    return np.unique(table, axis=0, return_inverse=True)[1].ravel()


def explore(start, classes: np.ndarray, step) -> tuple[list, np.ndarray]:
    """All states that ``step`` (state, byte) reaches from ``start``, and their transitions by class."""
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    states, number, table = [start], {start: 0}, []
    for state in states:
        row = []
        for byte in samples:
            if (to := step(state, byte)) not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return states, np.array(table)


def minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton with the same marks: states are split until all of a part move alike. State 0 stays first."""
    part = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    part = (part - part[0]) % (part.max() + 1)  # the start's part becomes 0
    one = np.unique(part, return_index=True)[1]
    return part[table[one]], marks[one]


class Scanner:
    """Arrays of the joint automaton and, by rule, of the reversed one and of the head's."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, nfas, ends, heads = rules, [], [], []
        for rule in rules:
            nfa, head = Nfa(), Nfa()
            ends.append(nfa.build(f"({rule.head})({rule.value})", rule.any_case))
            nfas.append(nfa)
            heads.append((head, *head.build(rule.head, rule.any_case)))
        self.classes = classes_of(nfas)
        alone = [explore(((), False), self.classes, partial(self._step, nfa, *both)) for nfa, both in zip(nfas, ends)]
        moves = [table[:, self.classes].tolist() for _, table in alone]
        states, table = explore((0,) * len(rules), self.classes, lambda state, byte: tuple(m[s][byte] for m, s in zip(moves, state)))
        marks = np.array([sum(1 << k for k, s in enumerate(state) if alone[k][0][s][1]) for state in states])
        table, self.found = minimised(table, marks)
        self.n_classes = table.shape[1]
        self.table = (table * self.n_classes).astype(np.int32).ravel()  # the row that a state's next byte indexes
        self.byte_class = self.classes.astype(np.uint8)
        # Bytes that bring every state to one that goes on as the start does, whatever it has found.
        calm = (table == table[0]).all(axis=1)
        self.resets = calm[table].all(axis=0)[self.classes]
        self.back = [self._anchored(nfa.reversed(), z, a) for nfa, (a, z) in zip(nfas, ends)]
        self.head = [self._anchored(*head) for head in heads]
        self.shortest = [self._shortest(nfa, a, z) for nfa, (a, z) in zip(nfas, ends)]
        if min(self.shortest, default=1) < 1:
            raise ValueError("a rule matches the empty text")

    @staticmethod
    def _step(nfa: Nfa, first: int, last: int, state: tuple, byte: int) -> tuple:
        """One byte on in one rule: its threads by start, and whether a match ended before this byte."""
        threads, _ = state
        accepting = bool(threads) and last in threads[-1]
        if accepting and len(threads) > 1:
            raise ValueError("a rule can match while an earlier start of it may still")
        moved = [m for t in threads if (m := nfa.step(t, byte))]
        found = accepting and not moved
        if accepting and moved and last not in moved[0]:
            raise ValueError("a rule's match would not be known when it ends")
        if not accepting or found:
            moved += [m for m in [nfa.step(nfa.closed([first]), byte)] if m]
        kept, seen = [], frozenset()
        for m in moved:
            own = m - seen  # what an earlier start has reached goes on as its own
            if own:
                kept.append(own)
                seen |= own
            if last in own:
                break
        return tuple(kept), found

    def _anchored(self, nfa: Nfa, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Transitions, with the dead state last, and which states accept."""
        states, table = explore(nfa.closed([first]), self.classes, nfa.step)
        dead = states.index(frozenset()) if frozenset() in states else None
        accept = np.array([last in s for s in states])
        if dead is not None:
            order = [i for i in range(len(states)) if i != dead] + [dead]
            place = np.argsort(order)
            table, accept = place[table[order]], accept[order]
        else:
            table, accept = np.vstack([table, np.full(table.shape[1], len(states))]), np.append(accept, False)
        return table, accept

    def _shortest(self, nfa: Nfa, first: int, last: int) -> int:
        now, size = {nfa.closed([first])}, 0
        while not any(last in s for s in now):
            now, size = {nfa.step(s, b) for s in now for b in {int(np.flatnonzero(some)[0]) for q in s for some, _ in nfa.moves[q]}}, size + 1
        return size

    def matches_ended(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places before which matches ended, in order, and the rules of those matches as bits. ``data`` ends with END."""
        kinds = self.byte_class[data]
        resets = np.flatnonzero(self.resets[data])
        wanted = np.searchsorted(resets, np.arange(RUN_BYTES, len(data), RUN_BYTES))
        begins = np.unique(np.concatenate([[0], resets[wanted[wanted < len(resets)]] + 1]))
        begins = begins[begins < len(data)]
        stops = np.append(begins[1:], len(data))
        order = np.argsort(begins - stops, kind="stable")  # the longest runs first
        begins, stops = begins[order], stops[order]
        sizes = stops - begins
        found_at, found = [], []
        state, marks = np.zeros(len(begins), np.int32), self.found
        n, done = len(begins), 0
        while n >= FEW_RUNS:
            now = self.table[state[:n] + kinds[begins[:n] + done]]
            state[:n] = now
            hit = np.flatnonzero(marks[now // self.n_classes])
            if len(hit):
                found_at.append(begins[hit] + done)
                found.append(marks[now[hit] // self.n_classes])
            done += 1
            n = int(np.searchsorted(-sizes, -done, "left"))
        table, told = self.table.tolist(), (marks > 0).tolist()
        for k in range(n):
            at, own, places = int(begins[k]) + done, int(state[k]), []
            for kind in kinds[at : stops[k]].tobytes():
                own = table[own + kind]
                if told[own // self.n_classes]:
                    places.append((at, own // self.n_classes))
                at += 1
            if places:
                found_at.append(np.array([p for p, _ in places]))
                found.append(marks[[s for _, s in places]])
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, bits = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(at, kind="stable")
        return at[order], bits[order]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text with any: (rule, start, end) in characters, by start, then in the rules' order."""
        rows = len(offsets) - 1
        marked = np.full(len(data) + rows, END, np.uint8)
        places = offsets + np.arange(rows + 1)
        inside = np.ones(len(marked), bool)
        inside[places[1:] - 1] = False
        marked[inside] = data
        at, bits = self.matches_ended(marked)
        out: dict[int, list[tuple[int, int, int]]] = {}
        raw = None
        for k, rule in enumerate(self.rules):
            ends = at[(bits >> k & 1) > 0]
            before = np.concatenate([[0], ends[:-1]])
            least = max(rule.least, rule.least_value, self.shortest[k])
            far = ends - before >= least
            for end, last in zip(ends[far].tolist(), before[far].tolist()):
                if raw is None:
                    raw = marked.tobytes()
                begin = end - self._longest(self.back[k], reversed(raw[last:end]))
                value = end - begin - self._longest(self.head[k], raw[begin:end])
                if end - begin >= rule.least and value >= rule.least_value:
                    row = int(np.searchsorted(places, begin, "right")) - 1
                    out.setdefault(row, []).append((k, begin, end))
        for row, found in out.items():
            low = int(places[row])
            stretch = np.frombuffer(raw, np.uint8)[low : places[row + 1]]
            lead = np.concatenate([[0], np.cumsum((stretch & 0xC0) != 0x80)])
            found[:] = [(k, int(lead[a - low]), int(lead[z - low])) for k, a, z in sorted(found, key=lambda f: (f[1], f[0]))]
        return out

    def _longest(self, automaton: tuple[np.ndarray, np.ndarray], data: Iterable[int]) -> int:
        """Size of the longest beginning of ``data`` that the automaton accepts."""
        table, accept = automaton
        dead, state, best, classes = len(accept) - 1, 0, 0, self.byte_class
        for n, byte in enumerate(data, 1):
            state = table[state, classes[byte]]
            if accept[state]:
                best = n
            elif state == dead:
                break
        return best


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The automaton of ``rules``, built once a process."""
    return Scanner(rules)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``spans``: (kind, start, end) of the secrets in each text, in characters, end exclusive, by start and
    then in the rules' order.

    Of each kind the leftmost matches that do not overlap, each as long as can be; those under the rule's least sizes
    are dropped, and what they cover is not searched again. Narrow: a row for each row, repeated ones too. A null or
    empty text has no spans; an empty table gives no rows; other columns are ignored, whatever their names; ``keep``
    may not name ``spans``. A long text is scanned whole; a worker holds about 2 MB at a time, or one text.
    """
    if "spans" in keep:
        raise ValueError("spans is a column of the result")
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"spans {SPANS}"])
    kinds, names = [r.kind for r in rules], [f.name for f in fields]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    own = scanner(rules)  # built on the driver: tasks get its arrays, and a bad rule fails here

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for first, stop in row_chunks(offsets, BATCH_BYTES):
                part = offsets[first : stop + 1]
                found = own.spans(data[part[0] : part[-1]], part - part[0])
                flat = [(k, a, z) for row in sorted(found) for k, a, z in found[row]]
                sizes = np.zeros(stop - first, np.int64)
                for row, some in found.items():
                    sizes[row] = len(some)
                columns = [pa.array([kinds[k] for k, _, _ in flat], pa.string()), pa.array([a for _, a, _ in flat], pa.int64()), pa.array([z for *_, z in flat], pa.int64())]
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, fields=list(span)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, stop - first) for i in range(len(names))), lists], names=[*names, "spans"])

    return df.select(*(F.col(c) for c in keep), F.col(text)).mapInArrow(run, schema)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``<kind>``; of spans that overlap, the first's name stands for what they
    cover together."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).cast("bigint").alias("at"))
    piece = lambda acc, s: F.struct(
        F.when(s["start"] + 1 < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substr(text, acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))).alias("out"),
        F.greatest(acc["at"], s["end"] + 1).alias("at"),
    )
    return F.aggregate(spans, start, piece, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int"), F.length(text) + 1)))
