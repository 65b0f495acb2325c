"""Probabilistic automata of credential formats, inferred from labelled strings by merging states.

The strings make a prefix tree whose states count how often they were passed, left by each character, and ended in.
States are then folded into one another where their frequencies are statistically compatible: their shares of every
character and of ending differ by less than the Hoeffding bound allows, and so do those of all states below them. What
is left is a deterministic automaton with a probability for every string.

`infer` does this on the strings it is given. `learn` does it on a column of strings of any size, in rounds: Spark runs every
string through the states found so far and counts, at each state and on the next `LOOK` characters of a string that goes
on by a character without a state, how often each character came. Only these counts are merged on the driver, as far as they
reach; the next round counts from there. The last round meets no character without a state, so that the automaton's
numbers are those of all strings. No state is left out for being rare; only how many states are held apart has a bound,
beyond which a further one joins the state it differs from least.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One minus the confidence with which two states are held apart.
ALPHA = 0.05
#: What a character gets in a state that never saw it, in strings; and how many characters a credential may have.
UNSEEN, ALPHABET = 0.5, 66
#: States that `learn` holds apart at most.
STATES = 256
#: Characters that a round looks ahead; states within the first half of them are merged in it.
LOOK = 12
#: What fewer than one in so many strings have in common is looked at when its first character is next, not ahead of that.
AHEAD = 2_000
#: Counters that a task keeps before it hands them on.
COUNTERS = 200_000


class State:
    """Strings that came by and that ended here; for each character how many went on by it, and to which state. How they
    went on may not be known yet, or not far enough to merge the state."""

    __slots__ = ("seen", "ended", "left", "after", "known", "ready")

    def __init__(self, seen: int = 0, known: bool = True, ready: bool = True):
        self.seen, self.ended = seen, 0
        self.known, self.ready = known, ready
        self.left: dict[str, int] = {}
        self.after: dict[str, State] = {}


def prefix_tree(strings: Iterable[str]) -> State:
    root = State()
    for text in strings:
        now = root
        for char in text:
            now.seen += 1
            now.left[char] = now.left.get(char, 0) + 1
            now = now.after.setdefault(char, State())
        now.seen += 1
        now.ended += 1
    return root


def distance(one: State, two: State, bound: float, most: float) -> float:
    """How far the frequencies of two states, and of those that the same strings reach from both, differ at most, where
    `bound` is what chance allows. Infinite beyond `most`. Below `two` there is a tree, so the walk ends."""
    far, pairs = 0.0, [(one, two)]
    while pairs:
        a, b = pairs.pop()
        if not (a.known and b.known) or bound / math.sqrt(b.seen) >= 1:  # no frequency can differ by more
            continue
        unit = 1 / math.sqrt(a.seen) + 1 / math.sqrt(b.seen)
        far = max(far, abs(a.ended / a.seen - b.ended / b.seen) / unit)
        for c in a.left.keys() | b.left.keys():
            far = max(far, abs(a.left.get(c, 0) / a.seen - b.left.get(c, 0) / b.seen) / unit)
        if far > most:
            return math.inf
        pairs += [(a.after[c], b.after[c]) for c in a.after.keys() & b.after.keys()]
    return far


def fold(into: State, tree: State) -> list[tuple[State, list[str]]]:
    """Add the counts of a tree to the automaton, state by state. The states that got some, and by which characters."""
    pairs, touched = [(into, tree)], []
    while pairs:
        a, b = pairs.pop()
        if not (a.known and b.known):  # counted again from here in the next round
            continue
        a.seen += b.seen
        a.ended += b.ended
        for char, n in b.left.items():
            a.left[char] = a.left.get(char, 0) + n
            if char in a.after:
                pairs.append((a.after[char], b.after[char]))
            else:
                a.after[char] = b.after[char]
        touched.append((a, list(b.left)))
    return touched


def grow(stay: list[State], alpha: float = ALPHA, most: int | None = None) -> None:
    """Merge the states next to those that stay, as far as they are ready. The one most often seen is taken first: it is
    folded into the first state that it is compatible with, or stays itself; where `most` stay, into the nearest."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    number = {id(s): i for i, s in enumerate(stay)}
    edges: list[tuple[int, int, str]] = []

    def offer(i: int, chars: Iterable[str]) -> None:
        for char in chars:
            state = stay[i].after[char]
            if state.ready and id(state) not in number:
                heapq.heappush(edges, (-state.seen, i, char))

    for i, state in enumerate(stay):
        offer(i, state.after)
    while edges:
        seen, i, char = heapq.heappop(edges)
        tree = stay[i].after[char]
        if id(tree) in number or tree.seen != -seen:  # merged, or offered again with more
            continue
        into = next((s for s in stay if distance(s, tree, bound, bound) <= bound), None)
        if into is None and most is not None and len(stay) >= most:
            least = math.inf
            for s in stay:
                far = distance(s, tree, bound, least)
                if into is None or far < least:
                    into, least = s, min(far, least)
        if into is None:
            number[id(tree)] = len(stay)
            stay.append(tree)
            offer(len(stay) - 1, tree.after)
        else:
            stay[i].after[char] = into
            for state, chars in fold(into, tree):
                if id(state) in number:
                    offer(number[id(state)], chars)


def merge_states(root: State, alpha: float = ALPHA) -> list[State]:
    """The states of a whole prefix tree that stay."""
    stay = [root]
    grow(stay, alpha)
    return stay


class Automaton:
    """Log probabilities by state and character, as plain numbers that travel with a function."""

    def __init__(self, states: list[State]):
        number = {id(s): i for i, s in enumerate(states)}
        self.counts = [{**s.left, "": s.ended} for s in states]
        total = self.totals = [s.seen + UNSEEN * (ALPHABET + 1) for s in states]
        self.steps = [{c: (number[id(s.after[c])], math.log((n + UNSEEN) / t)) for c, n in s.left.items()}
                      for s, t in zip(states, total, strict=True)]
        self.ends = [math.log((s.ended + UNSEEN) / t) for s, t in zip(states, total, strict=True)]
        self.other = [math.log(UNSEEN / t) for t in total]

    def score(self, text: str) -> float:
        """Logarithm of the probability of the whole text and its end. A character that a state never saw costs the
        floor and leaves the state as it is."""
        total, now = 0.0, 0
        for char in text:
            step = self.steps[now].get(char)
            if step is None:
                total += self.other[now]
            else:
                now, logarithm = step
                total += logarithm
        return total + self.ends[now]

    def score_without(self, text: str) -> float:
        """The same for one of the strings that were counted, from the counts of all others."""
        now, path = 0, []
        for char in text:
            path.append((now, char))
            now = self.steps[now][char][0]
        path.append((now, ""))
        own, came = Counter(path), Counter(state for state, _ in path)
        return sum(k * math.log((self.counts[s][c] - k + UNSEEN) / (self.totals[s] - came[s])) for (s, c), k in own.items())

    def mean_score(self, text: str) -> float:
        """The same for each character and the end."""
        return self.score(text) / (len(text) + 1)


def infer(strings: Iterable[str], alpha: float = ALPHA) -> Automaton:
    return Automaton(merge_states(prefix_tree(strings), alpha))


def counts_of(values: DataFrame, steps: dict[str | None, list[dict[str, int]]], least: dict[str | None, int]) -> DataFrame:
    """How all strings of the named kinds go on: kind, state, the `path` from it (empty: at the state itself), how many
    were `seen` there and what they `went` on by, the empty character where they ended."""
    names = ["kind", "least", "state", "path", "char", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_states = {kind: [defaultdict(int) for _ in known] for kind, known in steps.items()}
        ahead: dict[tuple, int] = defaultdict(int)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
            columns = zip(*found, strict=True) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind not in steps:
                    continue
                known, here, now = steps[kind], at_states[kind], 0
                for at, char in enumerate(value):
                    here[now][char] += 1
                    after = known[now].get(char)
                    if after is None:
                        for end in range(at + 1, min(at + LOOK, len(value)) + 1):
                            ahead[kind, now, value[at:end], value[end:end + 1]] += 1
                        break
                    now = after
                else:
                    here[now][""] += 1
            if len(ahead) > COUNTERS:
                yield rows([(k, least[k], s, path, c, n) for (k, s, path, c), n in ahead.items()])
                ahead.clear()
        yield rows([(k, least[k], s, path, c, n) for (k, s, path, c), n in ahead.items()]
                   + [(k, least[k], s, "", c, n) for k, states in at_states.items() for s, went in enumerate(states) for c, n in went.items()])

    found = values.select("kind", "value").mapInArrow(count, "kind string, least long, state int, path string, char string, n long")
    each = found.groupBy(*names[:5]).agg(F.sum("n").alias("n"))
    return (each.groupBy(*names[:4]).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("char", "n")).alias("went"))
            .filter((F.length("path") <= 1) | (F.col("seen") >= F.col("least"))).drop("least"))


def states_of(steps: list[dict[str, int]], went: dict[tuple[int, str], list]) -> list[State]:
    """The states found so far and the trees next to them, from what was counted."""
    stay = [State() for _ in steps]

    def fill(state: State, i: int, path: str) -> State:
        for char, n in went.get((i, path), ()):
            if char:
                state.left[char] = n
                if not path and char in steps[i]:
                    state.after[char] = stay[steps[i][char]]
                else:
                    known = (i, path + char) in went
                    state.after[char] = fill(State(n, known, known and len(path) < LOOK // 2), i, path + char)
            else:
                state.ended = n
        return state

    for i, state in enumerate(stay):
        state.seen = sum(n for _, n in went.get((i, ""), ()))
        fill(state, i, "")
    return stay


def learn(values: DataFrame, alpha: float = ALPHA, states: int = STATES) -> dict[str | None, Automaton]:
    """An automaton for each `kind` (which may be null), from every row's `value`."""
    sizes = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}
    least = {kind: -(-n // AHEAD) for kind, n in sizes.items()}
    steps: dict[str | None, list[dict[str, int]]] = {kind: [{}] for kind in sizes}
    done = {}
    while steps:
        went: dict[str | None, dict] = {kind: {} for kind in steps}
        for r in counts_of(values, steps, least).collect():
            went[r["kind"]][r["state"], r["path"]] = r["went"]
        for kind in list(steps):
            stay = states_of(steps[kind], went[kind])
            if all(state.after.keys() == known.keys() for state, known in zip(stay, steps[kind], strict=True)):
                done[kind] = Automaton(stay)
                del steps[kind]
                continue
            grow(stay, alpha, states)
            number = {id(s): i for i, s in enumerate(stay)}
            steps[kind] = [{c: number[id(y)] for c, y in s.after.items() if id(y) in number} for s in stay]
    return done
