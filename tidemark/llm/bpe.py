"""BPE encoding and decoding with a tokenization automaton."""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import map_arrow, table

#: Fixed value: the pattern of byte-level tokenizers that cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _upper_bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where key comes after what isn't above it in values[low:high], sorted, for rows side by side."""
    while (low < high).any():
        middle = (low + high) >> 1
        after = (values[middle] <= key) & (low < high)
        low, high = np.where(after, middle + 1, low), np.where(after, high, np.minimum(middle, high))
    return low


def unmet(rules: dict) -> list[str]:
    """What a vocabulary's file asks for that isn't carried out here, so that ids would be others than its library's. A
    model alone, without an entry for a pre-tokenizer, asks for none; whole texts need one (see Codec)."""
    model, before, after = rules["model"], rules.get("pre_tokenizer") or {}, rules.get("decoder") or {}
    asked = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": rules.get("normalizer") is not None,
        "a pre-tokenizer other than ByteLevel with its pattern and without a space before the text": "pre_tokenizer" in rules and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True),
        "a decoder other than ByteLevel": after.get("type", "ByteLevel") != "ByteLevel",
        **{f"the model's {k}": bool(model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        **{f"added tokens with {k}": any(a.get(k) for a in rules["added_tokens"]) for k in ("single_word", "lstrip", "rstrip")},
    }
    return [what for what, is_asked in asked.items() if is_asked]


class Automaton:
    """The deterministic automaton whose paths are the tokenizations BPE gives, compiled merge by merge into tables.

    At first there is one state, with an arc for each byte back to itself. The gadget of merge (u, v) -> uv takes the
    arc v out of the states reached by u, and adds, wherever u then v could be read, an arc uv to a copy of the state that
    v led to. Later gadgets copy what is left. All arcs of one label lead to one state, so states are numbered as tokens,
    and an arc (state, label) leads to the state `label`; the first state is the last number.

    What a gadget takes out in the end is a rectangle: all copies of state u made after it, and all labels that are made
    after it from v on. When tokens are ranked by a walk over the tree of left parts, the latest children first, these
    labels are a run of ranks. So a state's table is a sorted list of runs of labels that have no arc (from
    out_at[state] on, out_begin and out_end), and a transition is one binary search in it.

    The automaton has exactly one path over the bytes of a word; its labels are the encoding. Every beginning of a word
    has one path too, so the path grows byte by byte: step() leads to the longest text that some label begins with and
    that the bytes read so far end with (the table of steps lists those that make such a text longer; a place without one
    steps as its longest end inside it), `longest` names the longest label at its end, `shorter` the next one, and the
    one of them is taken that has an arc from the state where it begins.

    So gadgets are compiled as what they leave out in the end, in closed form, and a word is read through the table of
    steps, which proposes labels, and the tables of arcs, which decide. Vocabularies that ask for more than byte-level
    BPE with the usual pattern (see unmet()) are an error.
    """

    def __init__(self, spec: bytes):
        rules = json.loads(spec)
        if wrong := unmet(rules):
            raise ValueError(f"this vocabulary asks for what isn't done here: {'; '.join(wrong)}")
        self.specials = {a["content"]: a["id"] for a in rules["added_tokens"]}
        byte = _byte_of_symbol()
        vocab = rules["model"]["vocab"]
        special = set(self.specials.values())
        spelled = {i: bytes(byte[c] for c in s) for s, i in vocab.items() if i not in special and all(c in byte for c in s)}
        self.label = spelled | {i: s.encode() for s, i in self.specials.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        self.size = max(self.label) + 2
        self.start = self.size - 1
        self.length = np.zeros(self.size, np.int32)
        self._gadgets(merges)
        self._reading({i: t for i, t in spelled.items() if len(t) == 1 or i in self.made})

    def _gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        children: dict[int, list[int]] = {}
        first: dict[tuple[int, int], int] = {}
        for k, (u, v, uv) in enumerate(merges):
            first.setdefault((u, v), k)
            if uv not in self.made:  # a label made twice keeps its earlier gadget
                left[uv], right[uv], self.made[uv] = u, v, k
                children.setdefault(u, []).append(uv)
        # Ranks: every token, then what is made from it on its right, the latest first.
        self.rank = np.zeros(self.size, np.int64)
        end = np.zeros(self.size, np.int64)
        at = 0
        stack = [(t, False) for t in range(self.size) if t not in left]
        while stack:
            t, left_behind = stack.pop()
            if left_behind:
                end[t] = at
                continue
            self.rank[t] = at
            at += 1
            stack.append((t, True))
            stack += [(c, False) for c in children.get(t, ())]
        # The run of labels that each gadget takes out, by its left part and in order.
        begin_of = {v: [self.made[c] for c in cs] for v, cs in children.items()}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for (u, v), k in first.items():
            later = bisect.bisect_left(begin_of.get(v, []), k)
            last = end[children[v][later]] if later < len(children.get(v, ())) else self.rank[v] + 1
            runs.setdefault(u, []).append((k, self.rank[v], last))
        table_of = {u: np.array(sorted(r), np.int64) for u, r in runs.items()}
        states, begins, ends = [], [], []
        for s in range(self.size - 1):
            copied, before = s, len(merges)
            while True:
                got = table_of.get(copied)
                if got is not None and (n := int(np.searchsorted(got[:, 0], before))):
                    states.append(np.full(n, s, np.int64))
                    begins.append(got[:n, 1])
                    ends.append(got[:n, 2])
                if copied not in right:
                    break
                before = self.made[copied]
                copied = right[copied]
        none = [np.empty(0, np.int64)]
        shift = np.concatenate(none + states) * self.size
        b, e = np.concatenate(none + begins) + shift, np.concatenate(none + ends) + shift
        order = np.argsort(b, kind="stable")
        b, upto = b[order], np.maximum.accumulate(e[order])
        new = np.ones(len(b), bool)
        new[1:] = b[1:] > upto[:-1]
        begin, end = b[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)] if len(b) else upto
        self.out_at = np.searchsorted(begin, np.arange(self.size + 1) * self.size).astype(np.int32)
        state = np.repeat(np.arange(self.size), np.diff(self.out_at)) * self.size
        self.out_begin, self.out_end = np.append(begin - state, 0).astype(np.int32), np.append(end - state, 0).astype(np.int32)
        self.rank = self.rank.astype(np.int32)

    def _reading(self, tokens: dict[int, bytes]) -> None:
        """The table of steps and the labels that end at its places: a trie with the longest end of each place inside it."""
        child: dict[tuple[int, int], int] = {}
        ends_at: dict[int, int] = {}
        depth = [0]
        for i, t in tokens.items():
            self.length[i] = len(t)
            node = 0
            for n, x in enumerate(t):
                to = child.setdefault((node, x), len(child) + 1)
                if to == len(depth):
                    depth.append(n + 1)
                node = to
            ends_at[node] = i
        steps = np.array([(node << 8 | x, to) for (node, x), to in child.items()], np.int64).reshape(-1, 2)
        order = np.argsort(steps[:, 0])
        nodes = len(depth)
        key, target = steps[order].T
        before = key >> 8
        # The table of steps by hash: a step is in the first free slot from its own on.
        self.slots = max(2, 1 << int(4 * len(key)).bit_length() >> 1)
        self.step_key = np.full(self.slots + len(key) + 1, -1, np.int32)
        self.step_to = np.zeros(self.slots + len(key) + 1, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.step_key[slot[todo]] < 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.step_key[slot[free]], self.step_to[slot[free]] = key[free], target[free]
            todo = np.setdiff1d(todo, free, assume_unique=True)
            slot[todo] += 1
        self.inside = np.zeros(nodes, np.int32)
        self.longest = np.full(nodes, -1, np.int32)
        self.shorter = np.full(self.size, -1, np.int32)
        own = np.full(nodes, -1, np.int32)
        own[list(ends_at)] = list(ends_at.values())
        # Level by level: where a place's longest end is follows from that of the place before it.
        level = np.array(depth)[target]
        for n in range(1, max(depth) + 1):
            of = np.flatnonzero(level == n)
            to = target[of]
            if n > 1:
                self.inside[to] = self.step(self.inside[before[of]], (key[of] & 255).astype(np.uint8))
            label = own[to] >= 0
            self.shorter[own[to[label]]] = self.longest[self.inside[to[label]]]
            self.longest[to] = np.where(label, own[to], self.longest[self.inside[to]])

    def step(self, place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The places after one byte more. A byte that no label begins with leads to the first place."""
        out = np.zeros(len(place), np.int32)
        todo = np.arange(len(place))
        key = place << 8 | byte
        slot = self._slot(key)
        while len(todo):
            there = self.step_key[slot]
            hit = there == key
            out[todo[hit]] = self.step_to[slot[hit]]
            # No such step: on from the longest end inside; another step in the slot: on to the next slot.
            on = ~hit & ((there >= 0) | (key > 255))
            todo, key, slot, none = todo[on], key[on], slot[on] + 1, there[on] < 0
            key[none] = self.inside[key[none] >> 8] << 8 | (key[none] & 255)
            slot[none] = self._slot(key[none])
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(33 - self.slots.bit_length())).astype(np.int32)

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether there is an arc `label` from each state, for states and labels side by side."""
        rank, low = self.rank[label], self.out_at[state]
        run = _upper_bound(self.out_begin, low, self.out_at[state + 1], rank) - 1
        return (run < low) | (self.out_end[run] <= rank)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The labels of the one path over each word. Words of like length are read side by side, a byte at a time."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order) and words[order[at]]:
            longest = len(words[order[at]])
            some = order[at : at + max(1, (1 << 20) // longest)]
            some = [i for i in some if 2 * len(words[i]) >= longest or longest <= 16 and words[i]]
            for i, ids in zip(some, self._walk([words[i] for i in some])):
                out[i] = ids
            at += len(some)
        return out

    def _walk(self, words: list[bytes]) -> list[list[int]]:
        """words: the longest first, none of them empty."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths[0])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        reached = np.empty((width + 1, len(words)), np.int32)  # the state after so many bytes: the last label
        reached[0] = self.start
        place = np.zeros(len(words), np.int32)
        for n in range(1, width + 1):
            on = int(np.searchsorted(-lengths, -n, "right"))
            place = self.step(place[:on], text[:on, n - 1])
            label = self.longest[place]
            todo = np.arange(on)
            while len(todo):
                arc = self.has_arc(reached[n - self.length[label], todo], label)
                reached[n, todo[arc]] = label[arc]
                todo, label = todo[~arc], self.shorter[label[~arc]]
        # Each path from its end, side by side: the last label, then the one where that begins.
        word, place, path = np.arange(len(words)), lengths, []
        while (place > 0).any():
            label = np.where(place > 0, reached[place, word], -1)
            path.append(label)
            place = np.where(place > 0, place - self.length[label], 0)
        steps = np.array(path).T[:, ::-1]
        return [ids[skip:] for ids, skip in zip(steps.tolist(), (steps < 0).sum(1).tolist())]


class _Known(dict):
    """Encoded words. A word that isn't there gets an empty list, to be filled, and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> list[int]:
        self.new.append(word)
        ids = self[word] = []
        return ids


class Codec:
    """Whole texts: specials are cut out first, then words are looked up among those encoded before, or encoded."""

    def __init__(self, spec: bytes, most_words: int = 100_000):
        if "pre_tokenizer" not in json.loads(spec):
            raise ValueError("this vocabulary names no pre-tokenizer, without which whole texts aren't cut into words")
        self.automaton = Automaton(spec)
        self.words = regex.compile(WORDS)
        specials = self.automaton.specials
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.labels = [self.automaton.label.get(i, b"") for i in range(self.automaton.size)]
        self.numbers = [str(i) for i in range(self.automaton.size)]
        self.known = _Known()
        self.most_words = most_words

    def _pieces(self, text: str) -> list[str]:
        if not any(s in text for s in self.automaton.specials):
            return self.words.findall(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        if len(known) > self.most_words:
            known.clear()
        known.update((s, [i]) for s, i in self.automaton.specials.items())
        parts = [list(map(known.__getitem__, self._pieces(t))) for t in texts]
        new, known.new = known.new, []
        for w, ids in zip(new, self.automaton.encode_words([w.encode() for w in new])):
            known[w] += ids
            if len(w) >= 64:  # long ones hardly come again
                del known[w]
        return [list(itertools.chain.from_iterable(p)) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The labels of the path one after the other; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def written(self, ids: list[int]) -> str:
        """Decimal numbers with commas."""
        return ",".join(map(self.numbers.__getitem__, ids))


_codecs: dict[int, Codec] = {}


def codec(spec: bytes) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def vocabulary_bytes(docs: DataFrame, vocabulary: str) -> Broadcast:
    """The vocabulary's file, read on the driver and sent to the executors, which need no path to it."""
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ids, array<int>: the whole text's tokens as the vocabulary's own library gives them without adding
    special tokens; a special token's string in a text is that token. A null text is empty. No shuffle; memory is one
    batch of texts and a bounded table of words. vocabulary is a path on the driver. Empty docs give no rows; repeated
    rows are encoded alike; a column named ids is replaced."""
    docs = docs.drop("ids")
    shared = vocabulary_bytes(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array(c.encode([t or "" for t in part.column(text).to_pylist()]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return map_arrow(docs, work, _with(docs, "ids array<int>"))


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """tokens (with ids) plus decoded, the text of the ids; null or empty ids give an empty text, repeated rows the same
    text. A number that the vocabulary doesn't have is an error. No rows, no result; a column named decoded is replaced."""
    tokens = tokens.drop("decoded")
    shared = vocabulary_bytes(tokens, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([c.decode(i or []) for i in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return map_arrow(tokens, work, _with(tokens, "decoded string"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded again and hashed within one task, so
    that ids and decoded texts never leave it. A null text is an empty one, a null doc_id stays null, repeated rows are
    repeated; whole texts are taken whatever their length; no rows, no result; other columns don't matter."""
    shared = vocabulary_bytes(docs, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = c.encode([t or "" for t in part.column(text).to_pylist()])
                of_ids = [hashlib.sha256(c.written(ids).encode()).hexdigest() for ids in tokens]
                of_text = [hashlib.sha256(c.decode(ids).encode()).hexdigest() for ids in tokens]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array([len(ids) for ids in tokens], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text), work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(table(spark, sf_dir, "documents"), public_vocabulary())
