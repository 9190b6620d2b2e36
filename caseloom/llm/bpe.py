"""BPE by an automaton that is compiled from the merges; decoding emits arc labels."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm.common import slices, trim

#: Pieces of text beyond Latin letters in the younger of the two generations that a worker remembers.
REMEMBER = 150_000
#: Transitions out of the trie, and pairs of arcs, that a worker keeps at a time.
TRANSITIONS = 1_000_000
#: Bytes of the longest words that are read together; longer ones are read one by one.
TOGETHER = 64
#: Distinct pieces of a slice, or of one long text, that are encoded together.
BLOCK = 1 << 18
#: Pieces (RE2) that may hold a special token, or letters beyond U+024F.
ODD = r"<\||[^\x{0}-\x{24F}]"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Allowed(dict):
    """Whether an arc may stand behind another, by the packed pair of tokens."""

    def __init__(self, follows: Callable[[int, int], bool]):
        super().__init__()
        self.follows = follows

    def __missing__(self, pair: int) -> bool:
        if len(self) > TRANSITIONS:
            self.clear()
        got = self[pair] = self.follows(pair >> 16, pair & 0xFFFF)
        return got


class Chains(dict):
    """Of a token: itself, its first (side 0) or last part, that one's, and so on, each with the rank that ends it."""

    def __init__(self, parts: dict[int, tuple[int, int, int]], side: int):
        super().__init__()
        self.parts, self.side = parts, side

    def __missing__(self, token: int) -> list[tuple[int, int]]:
        chain = [(token, 1 << 62)]
        while (part := self.parts.get(chain[-1][0])) is not None:
            chain.append((part[self.side], part[2]))
        self[token] = chain
        return chain


class MergeAutomaton:
    """Deterministic token automaton of a vocabulary with ranked merges.

    It is compiled once: it starts as the automaton (a trie) that reads the strings of all
    tokens byte by byte, and the merges are applied in the order of their ranks. Where an arc
    u leads from p to q and an arc v from q to r, the gadget of the merge (u, v) adds the arc
    uv from p to r and takes v away from q. In a trie each state has one arc that enters it,
    so no state has to be split, and the arcs stay deterministic. Where gadgets of one merge
    overlap, those nearer the start come first, which is BPE's left-to-right rule.

    ``table`` holds the transitions: state and symbol (the byte, plus 256 if it ends the
    word) to state. ``parent`` and ``label`` hold the one arc that enters a state. A word is
    encoded by the transitions of its bytes, and its tokens are the labels of the arcs on the
    way; ``encode_words`` takes the transitions of many words together, a byte of each at a
    time. Within the trie the compiled arcs say them. A transition that leaves it goes to the
    longest string of the trie that ends there, as in string matching automata; the arc is
    then the one token that ends there (``ending``) and that no gadget takes away behind the
    arc before it (``follows``). There is exactly one, as every part of an encoding encodes
    its own bytes.
    """

    def __init__(self, inner: dict[bytes, int], last: dict[bytes, int], merges: dict[int, int], most: int = TRANSITIONS):
        self.inner, self.last, self.merges, self.most = inner, last, merges, most
        #: Of each merged token: its two parts, and the rank of the merge.
        self.parts = {m & 0xFFFF: (pair >> 16, pair & 0xFFFF, m >> 16) for pair, m in sorted(merges.items(), key=lambda x: -x[1])}
        self.table: dict[int, int] = {}
        self.parent, self.label, self.depth = [0], [-1], [0]
        ends = {self._add(t, final): (i, len(t)) for final, tokens in ((False, inner), (True, last)) for t, i in tokens.items()}
        self.base = dict(self.table)
        before = list(self.parent)
        self._compile()
        #: Where the arc that enters a state begins, in bytes from the start.
        self.start = [self.depth[p] for p in self.parent]
        # a token that its own bytes do not encode to is never an arc
        self.ending = self._ending(before, {s: x for s, x in ends.items() if self.label[s] == x[0] and not self.parent[s]})
        self.chains = Chains(self.parts, 0), Chains(self.parts, 1)
        self.allowed = Allowed(self.follows)
        self._arrays()

    def _arrays(self) -> None:
        """The transitions, arcs and ending tokens as arrays; ``first`` is where a state's ending tokens begin."""
        keys = np.fromiter(self.base.keys(), np.int32, len(self.base))
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(self.base.values(), np.int32, len(keys))[order]
        self.arcs = [np.array(x, np.int32) for x in (self.depth, self.label, self.start, self.fail)]
        sizes = np.fromiter(map(len, self.ending), np.int64, len(self.ending))
        self.first = np.cumsum(sizes) - sizes
        self.ends = np.array([x for e in self.ending for x in e], np.int64).reshape(-1, 2).T.copy()

    def _add(self, word: bytes, final: bool) -> int:
        """The state that a string leads to in the trie."""
        table, state = self.table, 0
        for k, b in enumerate(word):
            end = final and k == len(word) - 1
            key = state << 9 | (256 if end else 0) | b
            to = table.get(key)
            if to is None:
                to = table[key] = len(self.parent)
                self.parent.append(state)
                self.label.append((self.last if end else self.inner)[word[k : k + 1]])
                self.depth.append(k + 1)
            state = to
        return state

    def _ending(self, before: list[int], ends: dict[int, tuple[int, int]]) -> list[tuple]:
        """For each state of the trie ``(token, length)`` of the tokens that end its string, long ones first.

        ``before`` is the state one byte earlier. Fills ``fail``: the longest proper end of the
        string that is in the trie too.
        """
        symbol = [0] * len(before)
        for key, to in self.base.items():
            symbol[to] = key & 511
        self.fail = fail = [0] * len(before)
        out: list[tuple] = [()] * len(before)
        get = self.base.get
        for s in sorted(range(1, len(before)), key=self.depth.__getitem__):
            p, c = before[s], symbol[s]
            if p:
                f = fail[p]
                while (to := get(f << 9 | c)) is None and f:
                    f = fail[f]
                fail[s] = to or 0
            own = ends.get(s)
            out[s] = (own, *out[fail[s]]) if own else out[fail[s]]
        return out

    def _compile(self) -> None:
        """Apply all merges, lowest rank first."""
        parent, label, get = self.parent, self.label, self.merges.get
        after: list[list[int]] = [[] for _ in parent]  # states that arcs lead to, some of them moved since
        due: dict[int, list[int]] = {}  # of each rank: states whose arc is the second of the pair
        for r in range(1, len(parent)):
            q = parent[r]
            if q:
                after[q].append(r)
                m = get(label[q] << 16 | label[r])
                if m is not None:
                    due.setdefault(m, []).append(r)
        ranks = list(due)
        heapq.heapify(ranks)
        while ranks:
            m = heapq.heappop(ranks)
            states = due.pop(m)
            new = m & 0xFFFF
            states.sort()  # a state's number is greater than those of the states before it
            for r in states:
                q = parent[r]
                if not q or get(label[q] << 16 | label[r]) != m:
                    continue
                parent[r] = p = parent[q]
                label[r] = new
                if p:
                    after[p].append(r)
                    k = get(label[p] << 16 | new)
                    if k is not None:
                        if k in due:
                            due[k].append(r)
                        else:
                            due[k] = [r]
                            heapq.heappush(ranks, k)
                for s in after[r]:
                    if parent[s] == r:
                        k = get(new << 16 | label[s])
                        if k is not None:
                            if k in due:
                                due[k].append(s)
                            else:
                                due[k] = [s]
                                heapq.heappush(ranks, k)

    def follows(self, x: int, y: int) -> bool:
        """Whether the arc y stays behind the arc x when all gadgets have been applied.

        While the merges run, the end of x is a growing chain of tokens, and so is the
        beginning of y. A gadget takes y away if its pair stands at the border at its turn:
        before the left one becomes part of a larger token, and not after the right one does.
        """
        get, right = self.merges.get, self.chains[0][y]
        for a, until_a in self.chains[1][x]:
            for b, until_b in right:
                m = get(a << 16 | b)
                if m is not None and (m >> 16) < until_a and (m >> 16) <= until_b:
                    return False
        return True

    def _leave(self, state: int, symbol: int) -> int:
        """The transition out of the trie, kept in the table from then on."""
        if len(self.table) > len(self.base) + self.most:
            self.table = dict(self.base)
        f, get = state, self.base.get
        while (to := get(f << 9 | symbol)) is None:
            f = self.fail[f]
        self.table[state << 9 | symbol] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """Tokens of a word: transitions by the table, then the labels of the arcs."""
        depth, ending, allowed = self.depth, self.ending, self.allowed
        labels, starts, state, end = [-1], [0], 0, len(word)
        for k, b in enumerate(word, 1):
            symbol = b if k < end else 256 | b
            to = self.table.get(state << 9 | symbol)
            state = self._leave(state, symbol) if to is None else to
            if depth[state] == k:
                labels.append(self.label[state])
                starts.append(self.start[state])
                continue
            for t, size in ending[state]:
                at = k - size
                if not at or allowed[labels[at] << 16 | t]:
                    labels.append(t)
                    starts.append(at)
                    break
        out = []
        while end:
            out.append(labels[end])
            end = starts[end]
        return out[::-1]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of the trie; -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.targets[at], np.int32(-1))

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states behind a symbol each, by suffix links where it leaves the trie."""
        to = self._find(state << 9 | symbol)
        out = np.flatnonzero(to < 0)
        at = state[out]
        while len(out):
            at = self.arcs[3][at]
            to[out] = got = self._find(at << 9 | symbol[out])
            out, at = out[got < 0], at[got < 0]
        return to

    def _allow(self, pairs: np.ndarray) -> np.ndarray:
        pairs, where = np.unique(pairs, return_inverse=True)
        return np.fromiter(map(self.allowed.__getitem__, pairs.tolist()), bool, len(pairs))[where]

    def encode_words(self, data: np.ndarray, byte: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words in a row, and their number of each word: ``encode``, a byte of all words at a time.

        ``byte`` is where the words begin in the bytes of ``data``, ``size`` their length.
        """
        order = np.argsort(-size, kind="stable")
        byte, size = byte[order], size[order]
        # long words come first, so those with a k-th byte are a prefix; its arcs begin at row[k]
        reach = np.searchsorted(-size, -np.arange(size[0] + 1 if len(size) else 1), side="right")
        row = np.cumsum(reach) - reach
        label, start = np.full(reach.sum(), -1), np.zeros(reach.sum(), np.int64)
        depth, labels, starts, _ = self.arcs
        state = np.zeros(len(size), np.int32)
        for k in range(1, len(reach)):
            n = reach[k]
            state = self._step(state[:n], data[byte[:n] + k - 1].astype(np.int32) + 256 * (size[:n] == k).astype(np.int32))
            x, at = labels[state].astype(np.int64), starts[state].astype(np.int64)
            out = np.flatnonzero(depth[state] != k)
            end = self.first[state[out]]
            while len(out):
                t, length = self.ends[:, end]
                yes = self._allow(label[row[k - length] + out] << 16 | t)
                x[out[yes]], at[out[yes]] = t[yes], k - length[yes]
                out, end = out[~yes], end[~yes] + 1
            label[row[k] : row[k] + n], start[row[k] : row[k] + n] = x, at
        # back from the ends of the words
        word, end, found = np.flatnonzero(size), size[size > 0], []
        number = np.zeros(len(size), np.int64)
        while len(word):
            at = row[end] + word
            found.append((word, label[at]))
            number[word] += 1
            end = start[at]
            word, end = word[end > 0], end[end > 0]
        count = np.empty_like(number)
        count[order] = number
        behind = np.cumsum(count)[order]
        tokens = np.empty(count.sum(), np.int64)
        for k, (word, t) in enumerate(found, 1):
            tokens[behind[word] - k] = t
        return tokens, count


class Pieces(dict):
    """Pieces of text with their words, in two generations; the older is forgotten."""

    def __init__(self, cut: Callable[[str], list[str]]):
        super().__init__()
        self.cut, self.older = cut, {}

    def __missing__(self, piece: str) -> list[str]:
        if len(self) > REMEMBER:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            got = self.cut(piece)
        self[piece] = got
        return got


def joined(parts: pa.Array, index: np.ndarray, ends: np.ndarray | list[int], between: str = " ") -> pa.Array:
    """Strings of ``parts``: the k-th joins those at ``index[ends[k]:ends[k + 1]]``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts.take(pa.array(index))), between)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class WordBpe:
    """Encoder and decoder of a lower-casing word BPE file, equal to the tokenizers library.

    Special tokens in a text are found first. The rest is put into NFC, lower-cased
    letter by letter and cut into words by the file's pattern; white space never
    reaches a token, so texts can be taken piece by piece between white space. Of many
    texts the distinct pieces, and of these the distinct words, are encoded together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Of each pair of ids, packed into one number: the rank and the new id, packed.
        self.merges = {vocab[a] << 16 | vocab[b]: rank << 16 | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        inner, last = {}, {}
        for t, k in vocab.items():
            if t not in self.special:
                final = t.endswith(suffix)
                word = t[: len(t) - len(suffix)] if final else t
                (last if final else inner)[bytes([self.bytes[c] for c in word])] = k
        self.automaton = MergeAutomaton(inner, last, self.merges)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        #: Cuts lines of pieces; their ends come out as words of their own, as no word holds white space.
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.library = Tokenizer.from_file(path)
        self.known = Pieces(self.cut_odd)
        every = range(max(self.tokens) + 1)
        #: Ids and labels of the arcs as strings, by id.
        self.strings = [pa.array([f(i) for i in every], pa.string()) for f in (str, lambda i: self.tokens.get(i, ""))]

    def split(self, text: str) -> list[str]:
        """The words of lines of pieces up to U+024F without special tokens, and the ends of the lines."""
        return self.words.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def cut_odd(self, piece: str) -> list[str]:
        """The words of any piece; special tokens as they are, which the pattern never gives.

        Beyond Latin letters the library's own normalizer and splitter serve, whose
        tables of letters are of another Unicode version than Python's.
        """
        out = []
        for k, x in enumerate(self.cut.split(piece)):
            if k % 2:
                out.append(x)
            elif max(x, default="") > "ɏ":
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(x))
                out += [bytes([self.bytes[c] for c in w]).decode() for w, _ in cut]
            else:
                out += self.split(x)
        return out

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words in a row, and their number of each word; special tokens are themselves."""
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer(), np.uint8)
        byte = np.cumsum(size) - size
        alone = {k: [self.special[words[k].as_py()]] for k in np.flatnonzero(pc.is_in(words, pa.array([*self.special])))}
        for k in np.flatnonzero(size > TOGETHER):
            if k not in alone:
                alone[k] = self.automaton.encode(data[byte[k] : byte[k] + size[k]].tobytes())
        alone = dict(sorted(alone.items()))
        size[list(alone)] = 0
        tokens, count = self.automaton.encode_words(data, byte, size)
        if alone:
            n = [len(x) for x in alone.values()]
            tokens = np.insert(tokens, np.repeat(offsets(count)[list(alone)], n), [t for x in alone.values() for t in x])
            count[list(alone)] = n
        return tokens, count

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """Number of tokens, and ids and decoded text joined by blanks, of distinct pieces."""
        odd = pc.match_substring_regex(pieces, ODD).to_numpy(zero_copy_only=False)
        # words of all pieces in a row, each piece's closed by a line's end; the odd ones come last
        order = np.argsort(odd, kind="stable")
        some = len(pieces) - int(odd.sum())
        found = self.split(joined(pieces, order[:some], [0, some], "\n")[0].as_py() + "\n") if some else []
        for p in pieces.take(pa.array(order[some:])).to_pylist():
            found += self.known[p]
            found.append("\n")
        words = pa.array(found, pa.string()).dictionary_encode()
        index = words.indices.to_numpy()
        close = np.flatnonzero(index == words.dictionary.index("\n").as_py())
        n = np.diff(close, prepend=-1) - 1  # words of each piece
        index = np.delete(index, close)
        tokens, count = self.encode_words(words.dictionary)
        size = np.diff(offsets(count[index])[offsets(n)])
        back = np.argsort(order)
        strings = [joined(joined(x, tokens, offsets(count)), index, offsets(n)).take(pa.array(back)) for x in self.strings]
        return size[back], strings

    def encode_batch(self, texts: pa.Array) -> list[pa.Array]:
        """Count, ids joined by blanks, and decoded text of each text; null counts as empty.

        Texts are cut at ASCII white space only.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = cut.flatten().dictionary_encode()
        index, ends = pieces.indices.to_numpy(), cut.offsets.to_numpy()
        parts = [self.encode_pieces(pieces.dictionary.slice(k, BLOCK)) for k in range(0, len(pieces.dictionary) or 1, BLOCK)]
        size, strings = np.concatenate([x for x, _ in parts]), [pa.concat_arrays(x) for x in zip(*[x for _, x in parts], strict=True)]
        n = size[index]
        some = n > 0
        return [pa.array(np.diff(offsets(n)[ends])), *[joined(x, index[some], offsets(some)[ends]) for x in strings]]

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """``encode_batch`` of a list, row by row."""
        yield from zip(*[x.to_pylist() for x in self.encode_batch(pa.array(texts, pa.string()))], strict=True)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in next(self.encode_all([text]))[1].split()]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs (doc_id, text)``.

    ``ids`` holds the decimal ids joined by single blanks, ``decoded`` the text they
    decode to. Null and empty texts have no tokens, and empty strings. Whole texts
    of any length are encoded; rows that repeat and null doc_ids are kept as they
    are; other columns are ignored. ``path`` names the tokenizer file, which every
    executor must find there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)  # compiled in each task: an idle worker holds nothing
        try:
            for batch in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *bpe.encode_batch(batch.column("text"))], ["doc_id", "n_tokens", "ids", "decoded"])
        finally:
            del bpe
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
