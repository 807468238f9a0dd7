"""A byte-pair merge table compiled into a lazily determinised transducer.

Symbols are single characters; a token is a string of symbols. For every prefix
of a word there is one merge result, and it ends in the one token whose pair
with the token before it stays apart when both are merged alone. A state holds
the longest string of symbols with which a token may have begun, whose suffixes
show all places at which one may have begun, and for each place what the token
before it can still do: of the strings that stand at its right end as merging
goes on, those that some token begun there could still merge with, each with
its span of ranks. Tokens that behave alike to the right are one class, so
there are few states. States and transitions are made when a text first needs
them.

A transition of ``MergeTransducer`` tells the token in which the prefix's merge
result ends. Going back over these from every place that is still open, all
ways meet after a bounded number of symbols; what lies before is emitted. A
transition of ``CountingTransducer`` tells how many tokens became certain, and
its states also hold how many more there are up to each place. A
``BatchTransducer`` takes many words a symbol further at once: its transitions
lie in one table of arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: States kept before the table starts anew; bounds a worker's memory.
MAX_STATES = 200_000
#: Symbols after which a long word's certain tokens are emitted.
HOLD = 4096
NEVER = float("inf")
#: Symbols beyond which a word of a batch is run by itself.
LONG = 256
#: Bits of a table's key that hold the symbol, and of its value that hold the token's number.
SYMBOL, NUMBER = 21, 32


class MergeTransducer:
    def __init__(self, tokens: dict[str, int], pair_rank: Callable[[str, str], int | None]):
        self.tokens, self.pair_rank = tokens, pair_rank
        #: Strings that some token goes on from.
        self.heads = {t[:k] for t in tokens for k in range(1, len(t))}
        self._edges: tuple[dict, dict] = ({}, {})
        self._whole: dict[str, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ("", ((0, 0),))
        self._classes, self._class_ids = [()], {(): 0}  # a class without strings is never merged with
        self._narrower: dict[tuple[int, str], int] = {}
        self._class_of: dict[str, int] = {}
        self._apart: dict[tuple[int, str], bool] = {}
        self._steps: dict[tuple[str, str], tuple] = {}
        self._ids, self._states = {start: 0}, [start]
        self._moves: list[dict[str, tuple]] = [{}]

    def merge(self, parts: list[str], down_to: int = 1) -> list[str]:
        """Plain merging, lowest rank first and leftmost first; for single tokens."""
        parts = list(parts)
        while len(parts) > down_to:
            ranks = [(r, k) for k in range(len(parts) - 1) if (r := self.pair_rank(parts[k], parts[k + 1])) is not None]
            if not ranks:
                break
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def whole(self, token: str) -> bool:
        """Whether merging the token's symbols gives the token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(list(token)) == [token]
        return known

    def edge(self, token: str, side: int) -> tuple[tuple[str, float, float], ...]:
        """What stands at one end of the token (0: its first symbol, 1: its last) as merging goes on: string, rank that makes it, rank that ends it."""
        if (known := self._edges[side].get(token)) is None:
            if len(token) == 1:
                known = ((token, -1, NEVER),)
            else:
                two = self.merge(list(token), down_to=2)
                rank = self.pair_rank(*two)
                *before, (last, made, _) = self.edge(two[side], side)
                known = (*before, (last, made, rank), (token, rank, NEVER))
            self._edges[side][token] = known
        return known

    def _live(self, string: str, begun: str) -> bool:
        """Whether a token that begins with ``begun`` can have a first part that merges with ``string`` before it."""
        whole = string + begun
        return whole in self.heads or any(whole[:k] in self.tokens for k in range(len(string) + 1, len(whole) + 1))

    def _class(self, strings: tuple) -> int:
        if (known := self._class_ids.get(strings)) is None:
            known = self._class_ids[strings] = len(self._classes)
            self._classes.append(strings)
        return known

    def _after(self, token: str) -> int:
        """The class of a token that nothing follows yet."""
        if (known := self._class_of.get(token)) is None:
            known = self._class_of[token] = self._class(tuple(x for x in self.edge(token, 1) if x[0] in self.heads))
        return known

    def _narrow(self, cls: int, begun: str) -> int:
        """The class that is left of one once a token has begun after it."""
        if not cls:
            return 0
        if (known := self._narrower.get((cls, begun))) is None:
            known = self._narrower[cls, begun] = self._class(tuple(x for x in self._classes[cls] if self._live(x[0], begun)))
        return known

    def apart(self, cls: int, token: str) -> bool:
        """Whether a token of the class and the token after it stay as they are.

        Merges go by rising rank. A merge across the boundary comes first if
        its rank is below that of the next merge inside the left token and not
        above that inside the right one, while both strings stand there.
        """
        if not cls:
            return True
        if (known := self._apart.get((cls, token))) is None:
            known = True
            for left, made, ended in self._classes[cls]:
                for right, began, over in self.edge(token, 0):
                    if made <= over and began < ended and (rank := self.pair_rank(left, right)) is not None and rank < ended and rank <= over:
                        known = False
            self._apart[cls, token] = known
        return known

    def _step(self, begun: str, symbol: str) -> tuple[str, tuple[tuple[int, str], ...], tuple[tuple[int, str], ...]]:
        """What a symbol does to the tokens that may have begun, which are the suffixes of the longest: the longest after it; the places that stay open; those where a token ends."""
        open_, ends = [], []
        for place, k in enumerate([k for k in range(len(begun)) if begun[k:] in self.heads] + [len(begun)]):
            grown = begun[k:] + symbol
            if grown in self.heads:
                open_.append((place, grown))
            if grown in self.tokens and self.whole(grown):
                ends.append((place, grown))
        return (open_[0][1] if open_ else ""), tuple(open_), tuple(ends)

    def _goes(self, state: int, symbol: str) -> tuple[str, list, str, int]:
        """The longest begun token, the open places with class and count, the token that ends here, the count up to its end."""
        begun, places = self._states[state]
        if (step := self._steps.get((begun, symbol))) is None:
            step = self._steps[begun, symbol] = self._step(begun, symbol)
        longest, open_, ends = step
        for place, token in ends:
            cls, count = places[place]
            if self.apart(cls, token):
                break
        else:
            raise ValueError(f"no token ends at symbol {symbol!r}")
        return longest, [(self._narrow(places[k][0], grown), places[k][1]) for k, grown in open_], token, count + 1

    def _to(self, after: tuple) -> int:
        if (to := self._ids.get(after)) is None:
            to = self._ids[after] = len(self._states)
            self._states.append(after)
            self._moves.append({})
        return to

    def _arrow(self, state: int, symbol: str) -> tuple[int, str]:
        longest, places, token, _ = self._goes(state, symbol)
        return self._to((longest, (*[(c, 0) for c, _ in places], (self._after(token), 0)))), token

    def _move(self, state: int, symbol: str) -> tuple:
        move = self._moves[state][symbol] = self._arrow(state, symbol)
        return move

    def _open(self, state: int, at: int) -> list[int]:
        """The places, counted from the word's start, at which a token may have begun."""
        begun = self._states[state][0]
        return [at - len(begun) + k for k in range(len(begun)) if begun[k:] in self.heads] + [at]

    def _settled(self, state: int, held: list[str]) -> int:
        """Where the ways back from all open places meet."""
        ways = set(self._open(state, len(held)))
        while len(ways) > 1:
            last = max(ways)
            ways.remove(last)
            ways.add(last - len(held[last - 1]))
        return ways.pop()

    @staticmethod
    def _back(held: list[str], at: int) -> list[str]:
        out = []
        while at:
            out.append(held[at - 1])
            at -= len(held[at - 1])
        return out[::-1]

    def run(self, word: str) -> list[str]:
        """The tokens of a word, in order."""
        if len(self._states) > MAX_STATES:
            self._reset()
        out: list[str] = []
        state, moves, held = 0, self._moves, []
        for at in range(0, len(word), HOLD):
            if held:
                sure = self._settled(state, held)
                out += self._back(held, sure)
                del held[:sure]
            for symbol in word[at : at + HOLD]:
                try:
                    state, token = moves[state][symbol]
                except KeyError:
                    state, token = self._move(state, symbol)
                held.append(token)
        return out + self._back(held, len(held))


class CountingTransducer(MergeTransducer):
    def _move(self, state: int, symbol: str) -> tuple:
        longest, places, token, count = self._goes(state, symbol)
        places = (*places, (self._after(token), count))
        sure = places[0][1]
        to = self._to((longest, tuple([(c, n - sure) for c, n in places])))
        move = self._moves[state][symbol] = (to, sure)
        return move

    def count(self, word: str) -> int:
        """How many tokens a word has."""
        if len(self._states) > MAX_STATES:
            self._reset()
        total, state, moves = 0, 0, self._moves
        for symbol in word:
            try:
                state, sure = moves[state][symbol]
            except KeyError:
                state, sure = self._move(state, symbol)
            total += sure
        return total + self._states[state][1][-1][1]


class Table:
    """Whole numbers from 0 on, by keys of the same kind, in open addressing; asked and filled with many keys at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is none."""
        at = self._slots(keys)
        there, out = self.keys[at], self.values[at]
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.keys) - 1)
            there, out[on] = self.keys[at[on]], self.values[at[on]]
            on = on[(there != keys[on]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ and are not there yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.__init__(max(self.bits + 1, (2 * len(keys)).bit_length()))
        self.size += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            lost = self.keys[at] != keys
            self.values[at[~lost]] = values[~lost]
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & (len(self.keys) - 1)


class BatchTransducer(MergeTransducer):
    """Gives the tokens' numbers in ``tokens``."""

    def __init__(self, tokens: dict[str, int], pair_rank: Callable[[str, str], int | None]):
        super().__init__(tokens, pair_rank)
        self._lengths = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        self._lengths[list(tokens.values())] = list(map(len, tokens))

    def _reset(self) -> None:
        super()._reset()
        self._table = Table()

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """For keys of a state and a symbol, the state after it and the number of the token that ends there."""
        found = self._table.get(keys)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new, which = np.unique(keys[lacking], return_inverse=True)
            arrows = [self._arrow(key >> SYMBOL, chr(key & (1 << SYMBOL) - 1)) for key in new.tolist()]
            values = np.array([to << NUMBER | self.tokens[token] for to, token in arrows], np.int64)
            self._table.put(new, values)
            found[lacking] = values[which]
        return found

    def run_all(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' numbers of all words, on end, and how many each word has. Word k is ``symbols[bounds[k] : bounds[k + 1]]``."""
        if len(self._states) > MAX_STATES:
            self._reset()
        starts, ends = bounds[:-1], bounds[1:]
        ending, closes = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), bool)
        far = ends - starts > LONG
        for k in np.flatnonzero(far).tolist():
            numbers = np.array([self.tokens[t] for t in self.run("".join(map(chr, symbols[starts[k] : ends[k]].tolist())))])
            at = starts[k] + np.cumsum(self._lengths[numbers]) - 1
            ending[at], closes[at] = numbers, True
        starts, ends = starts[~far], ends[~far]
        longest_first = np.argsort(starts - ends, kind="stable")
        at, lengths = starts[longest_first], (ends - starts)[longest_first]
        going = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0))
        states = np.zeros(len(at), np.int64)
        for step, n in enumerate(going.tolist()):
            here = at[:n] + step
            found = self._found(states[:n] << SYMBOL | symbols[here])
            states[:n] = found >> NUMBER
            ending[here] = found & (1 << NUMBER) - 1
        # Back from the words' ends: each token begins where the one before it ends.
        back, start = ends[ends > starts], starts[ends > starts]
        while len(back):
            closes[back - 1] = True
            back = back - self._lengths[ending[back - 1]]
            back, start = back[back > start], start[back > start]
        before = np.concatenate([[0], np.cumsum(closes)])
        return ending[closes], np.diff(before[bounds])
