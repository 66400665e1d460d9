"""BPE as a deterministic automaton over tokens, compiled merge by merge.

The automaton starts with one state that allows every base symbol. The gadget of
the merge (u, v) -> w takes the state p that arcs labelled u enter, gives those arcs
a copy of p that no longer allows v, and adds an arc w from wherever u could
leave to wherever v led. What remains are the token sequences BPE produces, one
for each word. Arcs stay implicit: an arc w leaves a state if its left part did
when w's gadget was built, so a state stores only which arcs it lost, and when.

Words are encoded by tables, many at once: a prefix trie of the tokens gives the
candidates that end at a place, the automaton admits exactly one of them. The
admitted arcs' labels, in order, are the decoded text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mixed, named, worker_state
from panelspark.llm.tokens import _byte_letters

# code points with the White_Space property (fixed values)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NEVER = np.iinfo(np.int32).max
_CACHED_STRETCHES = 300_000
_STEP_ROWS = 400
_WORDS_AT_ONCE = 60_000


class Lookup:
    """A fixed integer map as two flat tables with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, missing, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            _, winners = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[winners]
            self.keys[slots[chosen]], self.values[slots[chosen]] = keys[chosen], values[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        found = self.values[slots]
        wrong = np.flatnonzero(self.keys[slots] != keys)
        while len(wrong):
            at = slots[wrong]
            found[wrong] = self.missing
            going = self.keys[at] != -1
            wrong = wrong[going]
            slots[wrong] = (slots[wrong] + 1) & self.mask
            found[wrong] = self.values[slots[wrong]]
            wrong = wrong[self.keys[slots[wrong]] != keys[wrong]]
        return found


class Automaton:
    """Compiled merges: states, lost arcs and the token trie."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        size = max(vocabulary.values()) + 1
        self.labels = [""] * size
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.left = np.full(size, -1, np.int32)  # left part of a merged token
        self.born = np.full(size, -1, np.int32)  # the merge that made it
        self.enters = np.zeros(size, np.int32)  # the state its arcs enter
        self.dead = np.zeros(size, bool)  # no arc has this label
        self._lost: list[dict[int, int]] = [{}]
        self._entered = {0: len(vocabulary) - len(merges) + 1}
        for rule, (a, b) in enumerate(merges):
            self._gadget(rule, vocabulary[a], vocabulary[b], vocabulary[a + b])
        lost = [(state << 20 | token, rule) for state, arcs in enumerate(self._lost) for token, rule in arcs.items()]
        self.lost = Lookup(*np.array(lost, np.int64).reshape(-1, 2).T, missing=_NEVER)
        self._trie(suffix)

    def _allows(self, state: int, token: int) -> bool:
        """Whether the token can leave the state now."""
        lost, until = self._lost[state], _NEVER
        while True:
            if self.dead[token] or lost.get(token, _NEVER) < until + (until < _NEVER):
                return False
            if self.left[token] < 0:
                return True
            token, until = int(self.left[token]), int(self.born[token])

    def _gadget(self, rule: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0:  # a later way to spell the same label never fires
            return
        state = int(self.enters[u])
        self.left[w], self.born[w] = u, rule
        self.dead[w] = self.dead[u] or not self._allows(state, v)
        after = int(self.enters[v])
        if self._entered[state] > 1 or u == v:
            self._entered[state] -= 1
            self._lost.append(dict(self._lost[state]))
            state = len(self._lost) - 1
            self._entered[state] = 1
            self.enters[u] = state
        self._lost[state][v] = rule
        self.enters[w] = after
        self._entered[after] = self._entered.get(after, 0) + 1

    def _trie(self, suffix: str) -> None:
        letters = _byte_letters()
        nodes: dict[int, int] = {}
        inner, final = [-1], [-1]
        for token, label in enumerate(self.labels):
            ends = label.endswith(suffix) and label != ""
            node = 0
            for letter in label[: -len(suffix)] if ends else label:
                key = node << 8 | letters[letter]
                if key not in nodes:
                    nodes[key] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                node = nodes[key]
            if node and ends:
                final[node] = token
            elif node:
                inner[node] = token
        self.inner, self.final = np.array(inner, np.int32), np.array(final, np.int32)
        self.steps = Lookup(np.fromiter(nodes, np.int64), np.fromiter(nodes.values(), np.int64), missing=-1)

    def admits(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token can leave each state of the finished automaton."""
        result = ~self.dead[tokens]
        result &= self.lost(states.astype(np.int64) << 20 | tokens) == _NEVER
        rows = np.flatnonzero(result & (self.left[tokens] >= 0))
        token = tokens[rows]
        while len(rows):
            part = self.left[token]
            fine = (self.lost(states[rows].astype(np.int64) << 20 | part) > self.born[token]) & ~self.dead[part]
            result[rows[~fine]] = False
            going = fine & (self.left[part] >= 0)
            rows, token = rows[going], part[going]
        return result

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word (at least one byte each)."""
        found: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, rows in by_length.items():
            step = max(1, _WORDS_AT_ONCE * 8 // (length + 8))
            for begin in range(0, len(rows), step):
                part = rows[begin : begin + step]
                for k, ids in zip(part, self._encode_equal([words[k] for k in part], length)):
                    found[k] = ids
        return found

    def _encode_equal(self, words: list[bytes], length: int) -> list[list[int]]:
        """Words of one length: from each place, follow the trie and take what is admitted."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(-1, length).astype(np.int64)
        last = np.full((len(words), length + 1), -1, np.int32)
        came = np.zeros((len(words), length + 1), np.int32)
        for place in range(length):
            state = self.enters[last[:, place]] if place else np.zeros(len(words), np.int32)
            rows, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            for end in range(place + 1, length + 1):
                node = self.steps(node << 8 | letters[rows, end - 1]).astype(np.int64)
                alive = node >= 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                token = (self.final if end == length else self.inner)[node]
                some = np.flatnonzero(token >= 0)
                some = some[self.admits(state[rows[some]], token[some])]
                last[rows[some], end] = token[some]
                came[rows[some], end] = place
        used = np.zeros((len(words), length + 1), bool)
        at = np.full(len(words), length)
        every = np.arange(len(words))
        while len(every):
            used[every, at] = True
            at = came[every, at]
            every, at = every[at > 0], at[at > 0]
        flat, ends = last[used].tolist(), np.cumsum(used.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """The compiled vocabulary file with the stretches seen so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        # the file's pre-token pattern; a stretch holds no white space
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
        self.specials = {t["content"]: str(t["id"]) for t in content["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.white = re.compile("[" + "".join(map(chr, _WHITE)) + "]+")
        self.narrow = re.compile("[\x1c-\x1f]")
        self.known: dict[str, tuple[str, str]] = {}
        self.decimal = [str(i) for i in range(len(self.automaton.labels))]
        self.known_words: dict[str, tuple[str, str]] = {}

    def stretches(self, text: str) -> list[str]:
        """Normalised text (NFC, each letter lower-cased alone) between white space."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        if self.narrow.search(text):  # separators that str.split takes for white space
            return [s for s in self.white.split(text) if s]
        return text.split()

    def learn(self, stretches: set[str]) -> None:
        """Encode the stretches not seen yet."""
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > _CACHED_STRETCHES:
            self.known.clear()
            new = list(stretches)
        pieces = [self.words.findall(s) for s in new]
        done = self.known_words
        words = list({w for p in pieces for w in p if w not in done})
        if len(done) + len(words) > _CACHED_STRETCHES:
            done.clear()
            words = list({w for p in pieces for w in p})
        labels, decimal = self.automaton.labels, self.decimal
        for word, ids in zip(words, self.automaton.encode([w.encode("utf-8", "surrogatepass") for w in words])):
            done[word] = " ".join([decimal[i] for i in ids]), " ".join([labels[i] for i in ids])
        for stretch, parts in zip(new, pieces):
            if len(parts) == 1:
                self.known[stretch] = done[parts[0]]
            else:
                both = [done[w] for w in parts]
                self.known[stretch] = " ".join([b[0] for b in both]), " ".join([b[1] for b in both])

    def encode(self, texts: list) -> list[tuple[str, str]]:
        """For each text the decimal ids and the arc labels, both joined by spaces."""
        split = []
        for text in texts:
            parts = self.special.split(text) if text and "<|" in text else [text or ""]
            split.append([p if k % 2 else self.stretches(p) for k, p in enumerate(parts)])
        self.learn({s for parts in split for p in parts if isinstance(p, list) for s in p})
        known = self.known
        found = []
        for parts in split:
            both = []
            for p in parts:
                both += [known[s] for s in p] if isinstance(p, list) else [(self.specials[p], p)]
            found.append((" ".join([b[0] for b in both]), " ".join([b[1] for b in both])))
        return found


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoder = worker_state(("bpe-automaton", vocabulary), lambda: Encoder(vocabulary))
    for batch in batches:
        for begin in range(0, batch.num_rows, _STEP_ROWS):
            part = batch.slice(begin, _STEP_ROWS)
            both = encoder.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in both], pa.int64()),
                    pa.array([ids for ids, _ in both], pa.large_string()).cast(pa.string()),
                    pa.array([text for _, text in both], pa.large_string()).cast(pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )


def _digested(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """The same with the digests in place of the ids and the text."""
    digest = lambda column: pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in column])
    for batch in _encoded(batches, vocabulary):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), digest(batch.column("ids")), digest(batch.column("decoded"))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(
    df: DataFrame, vocabulary: str, text_column: str = "text", id_column: str = "doc_id", digests: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (decimal, joined by spaces), decoded.

    A null or empty text has no tokens; repeated rows give repeated results, an
    empty table an empty one; other columns are not read. ``digests`` returns
    ids_sha256 and decoded_sha256 instead of ids and decoded. The vocabulary
    file must lie at the same path on every machine.
    """
    picked = df.select(named(df, id_column).cast("long").alias("doc_id"), named(df, text_column).alias("text"))
    if digests:
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        return picked.mapInArrow(partial(_digested, vocabulary=vocabulary), schema)
    return picked.mapInArrow(partial(_encoded, vocabulary=vocabulary), "doc_id long, n_tokens long, ids string, decoded string")
