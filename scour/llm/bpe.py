"""BPE encoding and decoding by an automaton over token sequences.

The automaton starts with one state and a loop for each base symbol. Merges are taken in order, and
each adds a gadget: after the left token comes a new state that no longer has the arc of the right
token, and wherever the left token may come, so may the merged one, which leads where the right
token led. In the end exactly the token sequences that the merges produce are accepted.

As a token always leads to one state, a state is named by the token. The arcs that a gadget takes
away are a token and everything merged onto its right since: one interval of a preorder of the
"left part of" forest, where later merges come first. A state is thus a sorted table of intervals,
and a transition is a lookup of the token's preorder number.

Each word has one accepted path. Encoding follows the arcs from left to right, longest label first,
and steps back where no arc goes on. Decoding emits the labels of the arcs.

Defined cases: a null text is empty and has no ids. Special tokens in a text are single ids. Very
long texts are encoded whole. Rows are independent: ties, repeated rows, empty tables and extra
columns change nothing. Ids outside the vocabulary can't be decoded and end the job.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

from scour.llm.remembered import Remembered


WORD_END = "</w>"
# Fixed value: the words of the tokenizer file's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of the latest distinct pieces that a task remembers, and as many from before.
REMEMBERED = 48 << 20
#: Documents that leave a worker at a time.
GROUP_TEXTS = 256

# Latin letters and common signs: there, Python and the tokenizer agree on case and white space,
# and composing characters changes nothing. Other texts are split by the tokenizer's own rules.
UNSURE = re.compile("[^\x00-\x1b\x20-ɏ‐-‧€]")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte) if byte in shown else chr(next(others)) for byte in range(256)]


class Automaton:
    """Transition tables compiled from the merges of a tokenizer file."""

    def __init__(
        self,
        vocabulary: dict[str, int],
        merges: list[tuple[str, str]],
        special: dict[str, int] | None = None,
    ):
        self.special = special or {}
        size = max([*vocabulary.values(), *self.special.values()], default=0) + 1
        self.labels = [""] * size
        for label, token in self.special.items():
            self.labels[token] = label
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        self.time = np.full(size, -1, np.int32)
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        self._add_gadgets(pairs)
        self._number_tokens(size)
        self._tabulate_states(size)
        made = {*(w for *_, w in pairs)}
        reachable = {w for w in made if self.time[w] >= 0}
        self.tokens = {
            label: token
            for label, token in vocabulary.items()
            if token in reachable or token not in made
        }

    def _add_gadgets(self, pairs: list[tuple[int, int, int]]) -> None:
        """Take the merges in order; `taken[u]` has the arcs lost after u and when."""
        self.taken: dict[int, dict[int, int]] = {}
        for now, (u, v, w) in enumerate(pairs):
            if not self._has_arc(u, v):
                continue  # the two never meet, so the merge never applies
            self.taken.setdefault(u, {})[v] = now
            self.left[w], self.right[w], self.time[w] = u, v, now

    def _has_arc(self, u: int, v: int) -> bool:
        """Whether v may follow u, by the gadgets so far."""
        before, state = len(self.time) * 2, u
        while state >= 0:
            lost = self.taken.get(state)
            token, since = v, len(self.time) * 2
            while lost and token >= 0:
                when = lost.get(token)
                if when is not None and when < before and when <= since:
                    return False
                since, token = self.time[token], self.left[token]
            before, state = min(before, self.time[state]), self.right[state]
        return True

    def _number_tokens(self, size: int) -> None:
        """Preorder numbers in the forest of left parts; children merged later come first."""
        children: dict[int, list[int]] = {}
        for token in np.argsort(self.time, kind="stable").tolist():
            children.setdefault(int(self.left[token]), []).append(token)
        self.number = np.zeros(size, np.int32)
        self.end = np.zeros(size, np.int32)
        stack, count = [(token, False) for token in children.get(-1, [])], 0
        while stack:
            token, done = stack.pop()
            if done:
                self.end[token] = count
                continue
            self.number[token] = count
            count += 1
            stack.append((token, True))
            # The last pushed comes first: the latest merge.
            stack.extend((child, False) for child in children.get(token, []))
        self._children = children

    def _tabulate_states(self, size: int) -> None:
        """Sorted, disjoint intervals of preorder numbers without an arc, per state."""
        starts, ends, offsets = [], [], [0]
        for state in range(size):
            lost = [] if self.labels[state].endswith(WORD_END) else self._lost(state)
            last = -1
            for start, end in sorted(lost):
                if start <= last:
                    last = ends[-1] = max(last, end)
                else:
                    starts.append(start)
                    ends.append(end)
                    last = end
            offsets.append(len(starts))
        self.starts = np.array(starts, np.int32)
        self.ends = np.array(ends, np.int32)
        self.offsets = np.array(offsets, np.int32)
        del self._children, self.taken, self.left, self.right

    def _lost(self, state: int) -> list[tuple[int, int]]:
        found, before = [], len(self.time) * 2
        while state >= 0:
            for token, when in self.taken.get(state, {}).items():
                if when < before:
                    found.append((int(self.number[token]), self._end_since(token, when)))
            before, state = min(before, int(self.time[state])), int(self.right[state])
        return found

    def _end_since(self, token: int, when: int) -> int:
        """End of the interval of a token and what was merged onto it at `when` or later."""
        children = self._children.get(token, [])
        low, high = 0, len(children)
        while low < high:
            middle = (low + high) // 2
            if self.time[children[middle]] >= when:
                high = middle
            else:
                low = middle + 1
        return int(self.end[children[low]]) if low < len(children) else int(self.number[token]) + 1


class Codec:
    """Encodes and decodes with a compiled automaton. It holds about 100 MB and is made for each task, in
    less than a second: workers live on between tasks, and other stages need the memory."""

    def __init__(self, automaton: Automaton, file: str):
        self.labels, self.special = automaton.labels, automaton.special
        self.tokens = automaton.tokens
        # The longest label after each beginning of up to three symbols.
        self.reach: dict[str, int] = {}
        for label in self.tokens:
            beginning, length = label[:3], len(label.removesuffix(WORD_END))
            for part in (beginning, beginning[:2], beginning[:1]):
                self.reach[part] = max(self.reach.get(part, 0), length)
        self.number = automaton.number.tolist()
        starts, ends = automaton.starts.tolist(), automaton.ends.tolist()
        cuts = automaton.offsets.tolist()
        self.lost = [(starts[a:b], ends[a:b]) for a, b in zip(cuts, cuts[1:])]
        rules = Tokenizer.from_str(file)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.symbols = byte_symbols()
        self.words = regex.compile(WORDS)
        self.pieces = Remembered(REMEMBERED)

    def _has_arc(self, state: int, token: int) -> bool:
        starts, ends = self.lost[state]
        number = self.number[token]
        place = bisect_right(starts, number) - 1
        return place < 0 or number >= ends[place]

    def encode_word(self, word: str) -> list[int]:
        """Token ids of a word in byte symbols.

        Transitions are tried from the longest label to the shortest. A position from which no path
        leads to the end is left for good, so each pair of position and label is tried once.
        """
        size, tokens, reach = len(word), self.tokens, self.reach
        ids: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        start, end = 0, min(size, reach.get(word[:3], 2))
        while start < size:
            while end > start:
                token = tokens.get(word[start:end] if end < size else word[start:] + WORD_END)
                if token is not None and end not in dead and (
                    not ids or self._has_arc(ids[-1], token)
                ):
                    break
                end -= 1
            if end > start:
                ids.append(token)
                ends.append(end)
                start, end = end, min(size, end + reach.get(word[end : end + 3], 2))
            elif ids:
                dead.add(start)
                ids.pop()
                end = ends.pop() - 1
                start = ends[-1] if ends else 0
            else:
                raise ValueError(f"No tokens for {word[:40]!r}")
        return ids

    def _packed(self, words: list[str]) -> bytes:
        return array("I", chain.from_iterable(map(self.encode_word, words))).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, from those remembered before, or made and remembered."""
        packed = self.pieces.before.get(piece)
        if packed is None:
            lowered = piece.lower()
            if lowered.isascii() and lowered.isalpha():
                packed = array("I", self.encode_word(lowered)).tobytes()
            else:
                packed = b"".join(map(self._word, self.words.findall(lowered)))
        self.pieces.keep(piece, packed)
        return packed

    def _word(self, word: str) -> bytes:
        """The ids of a word within a piece; it may stand in other pieces or alone."""
        packed = self.pieces.get(word) or self.pieces.before.get(word)
        if packed is None:
            shown = "".join(map(self.symbols.__getitem__, word.encode()))
            packed = array("I", self.encode_word(shown)).tobytes()
            self.pieces.keep(word, packed)
        return packed

    def _plain(self, text: str) -> bytes:
        if UNSURE.search(text):
            split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return self._packed([word for word, _ in split])
        known = self.pieces.get
        return b"".join([known(piece) or self._piece(piece) for piece in text.split()])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(token in text for token in self.special):
            return self._plain(text)
        parts = self.special_pattern.split(text)
        return b"".join(
            np.array([self.special[part]], "<u4").tobytes() if i % 2 else self._plain(part)
            for i, part in enumerate(parts)
        )

    def decode(self, ids: bytes | None) -> str:
        """The labels of the ids, with blanks between: these tokens carry their own word ends."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def automaton_of(file: str) -> Automaton:
    """Compile the content of a tokenizer file."""
    rules = json.loads(file)
    merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
    special = {token["content"]: token["id"] for token in rules["added_tokens"]}
    return Automaton(rules["model"]["vocab"], [tuple(m) for m in merges], special)


def transcode(
    documents: DataFrame,
    path: str,
    text: str = "text",
    ids: str | None = "ids",
    decoded: str | None = "decoded",
) -> DataFrame:
    """The documents with their packed ids and the text that the ids decode to; None leaves one out.

    Columns that have these names already are replaced. The tokenizer file is compiled on the
    driver; the tables are broadcast, they don't grow with the data. Results leave the worker a few
    hundred documents at a time.
    """
    spark = documents.sparkSession
    with open(path, encoding="utf-8") as file:
        content = file.read()
    compiled = spark.sparkContext.broadcast((automaton_of(content), content))
    added = [(name, kind) for name, kind in ((ids, BinaryType()), (decoded, StringType())) if name]
    kept = documents.drop(*[name for name, _ in added if name != text])
    schema = StructType(
        [field for field in kept.schema.fields if field.name not in dict(added)]
        + [StructField(name, kind) for name, kind in added]
    )
    old = [field.name for field in schema.fields[: -len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*compiled.value)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_TEXTS):
                part = batch.slice(at, GROUP_TEXTS)
                packed = list(map(codec.encode, part.column(text).to_pylist()))
                columns = [part.column(name) for name in old]
                if ids:
                    columns.append(pa.array(packed, pa.binary()))
                if decoded:
                    columns.append(pa.array(map(codec.decode, packed), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)
