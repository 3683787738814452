"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

**Encoding.** For byte-level BPE with a ranked merge list, a token sequence is the encoding of its bytes
exactly if each two neighbours, merged on their own, stay the two tokens they are. So the encoding of
every prefix is determined by its last token: the longest vocabulary entry that ends the prefix, encodes
to itself, and is compatible with the last token of the prefix before it. The transducer keeps that last
token for each position and walks the bytes once.

**Lookahead.** A token still to come starts at one of the last `lookahead` positions, where `lookahead` is the
length in bytes of the longest token that the merge list can make; no entry that ends a prefix is longer,
so no position before those is looked at again. So a token is stable, and is emitted, once the chains of
last tokens from all those positions go through it; what is kept is that window of positions and the
tokens between it and the last emitted boundary, not the text.

**Transitions.** Bytes arrive in pieces of at most `lookahead`; a transition takes (state, piece, whether
the word ends with it) to (tokens emitted, next state). Transitions met before are looked up. That is what
makes it fast: most words are one piece, from the state at a word's start to the one past its end.

**Words.** Before merging, the public pattern of byte-level BPE splits a text into words; no merge crosses
them. Text arrives in pieces too: a word is passed on once three more characters can't change where it
ends, and of a word that goes on past a piece all but its last characters, so a word may be of any length.

**Decoding.** An incremental UTF-8 decoder takes token bytes as they come and keeps only an unfinished
code point; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes at a prefix's end that narrow down which entries may end it.
NEAR = 4
#: The runs that a word of any length can be, but for its first character.
RUNS = {"letter": r"\p{L}*", "number": r"\p{N}*", "blank": r"\s*", "sign": r"[^\s\p{L}\p{N}]*"}
#: The last run of blanks of a stretch, searched from its end.
BLANKS = regex.compile(r"(?r)\s+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: token bytes, merge ranks, added tokens, sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._expect(file, path)
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in file["model"]["vocab"].items() if t not in self.added}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right = raw(a), raw(b)
            self.rank.setdefault((self.id_of[left], self.id_of[right]), (r, self.id_of[left + right]))
        made = {new for _, new in self.rank.values()}
        self.lookahead = max([1, *(len(self.bytes_of[t]) for t in made)])
        self._compatible: dict[tuple[int, int], bool] = {}
        #: The tokens that the encoding of their own bytes gives back; no other can stand in an encoding.
        self.entries: dict[bytes, int] = {}
        #: For each of these, the rank of the merge that made it (-1: a byte) and the two tokens merged.
        self.made: dict[int, tuple[int, int, int]] = {}
        for t, i in self.id_of.items():
            end, how = self._merged([self.id_of[t[k : k + 1]] for k in range(len(t))])
            if end == [i]:
                self.entries[t], self.made[i] = i, how
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        ends: dict[bytes, set[int]] = {}
        for t in self.entries:
            ends.setdefault(t[-NEAR:], set()).add(len(t))
        for t in list(ends):
            ends[t] |= {n for n in range(1, len(t)) if t[-n:] in self.entries}
        #: For the last NEAR bytes of a prefix (all, if it has fewer), the lengths of the entries that may end it, longest first.
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in ends.items()}

    @staticmethod
    def _expect(file: dict, path: str) -> None:
        """Refuses a file whose text would be split, changed or merged in another way than here."""
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        added = not any(a.get(k) for a in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and split and added and file.get("normalizer") is None and (file.get("decoder") or {}).get("type") == "ByteLevel"):
            raise ValueError(f"{path} is no plain byte-level BPE without a normalizer, prefix space or stripping added tokens")

    def _merged(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int]]:
        """Merges by rank, leftmost first, over the few bytes of a token; also the last merge made, as (rank, left, right)."""
        how = (-1, -1, -1)
        while len(ids) > 1:
            best = min(((*self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            at = best[2]
            how = (best[0], ids[at], ids[at + 1])
            ids[at : at + 2] = [best[1]]
        return ids, how

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, both entries, merge to just a and b.

        Undoes the merges of the two from the last to the first and looks at the tokens that then meet at
        the border: they stay apart if no merge of theirs comes before the one that takes either away. At
        equal ranks the left one of two merges comes first.
        """
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 500_000:
                self._compatible.clear()
            self._compatible[a, b] = known = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        rank, made, before = self.rank, self.made, 1 << 62
        while True:
            merge = rank.get((a, b))
            if merge is not None and merge[0] < before:
                return False
            left, right = made[a], made[b]
            if left[0] > right[0]:
                before, a = left[0], left[2]
            elif right[0] >= 0:
                before, b = right[0] + 1, right[1]
            else:
                return True

    def lengths(self, end: bytes) -> tuple[int, ...]:
        """The lengths of the entries that may end a prefix whose last NEAR bytes are `end`."""
        got = self.sizes.get(end)
        if got is None:
            got = tuple(n for n in range(len(end), 0, -1) if end[-n:] in self.entries)
            if len(self.sizes) < 400_000:
                self.sizes[end] = got
        return got

    def token(self, tail: bytes, last: list[int], before: int, end: int) -> int:
        """The last token of the encoding of tail[:end], longest first; `before` is the token that ends where tail begins, or -1.

        Looks up `last` for the prefix that an entry leaves, and finds out what isn't known there yet (-2).
        """
        entry, known = self.entries.get, self._compatible.get
        near = tail[end - NEAR if end > NEAR else 0 : end]
        sizes = self.sizes.get(near)
        for size in self.lengths(near) if sizes is None else sizes:
            start = end - size
            if start < 0:
                continue
            t = entry(tail[start:end])
            if t is None:
                continue
            if start:
                previous = last[start]
                if previous == -2:
                    previous = self.token(tail, last, before, start)
                if previous < 0:
                    continue
            elif before < 0:
                break
            else:
                previous = before
            ok = known((previous, t))
            if self.compatible(previous, t) if ok is None else ok:
                break
        else:
            t = -1
        last[end] = t
        return t


#: What a transducer keeps: bytes since the last emitted boundary, for each position of them the last token up to there, the token that ends at the boundary.
State = tuple[bytes, tuple[int, ...], int]
START: State = (b"", (-1,), -1)


class Transducer:
    """Transitions over the bytes of words. Two generations of at most `keep` that take a whole word, and as many as `states` others, are remembered, so memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 120_000, states: int = 2_000):
        self.v, self.keep, self.states = vocabulary, keep, states
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.others: dict[tuple[State, bytes], tuple[bytes, State]] = {}

    def _chain(self, tail: bytes, last, end: int) -> list[tuple[int, int]]:
        """(end position, token) of the tokens up to `end`, last first."""
        out, length = [], self.v.length
        while end:
            t = last[end]
            out.append((end, t))
            end -= length[t]
        return out

    def step(self, state: State, piece: bytes, ends: bool) -> tuple[list[int], State]:
        """One transition: the tokens that no further byte can change, all of them if the word ends, and the next state."""
        tail, last, before = state[0] + piece, [*state[1], *[-2] * len(piece)], state[2]
        token, length = self.v.token, self.v.length
        if ends:  # only the positions that the end asks for
            out, end = [], len(tail)
            while end:
                t = last[end]
                if t == -2:
                    t = token(tail, last, before, end)
                out.append(t)
                end -= length[t]
            return out[::-1], START
        for end in range(len(state[1]), len(tail) + 1):
            token(tail, last, before, end)
        if len(tail) < 4 * self.v.lookahead:
            return [], (tail, tuple(last), before)
        shared = None
        for p in range(len(tail) - self.v.lookahead + 1, len(tail) + 1):
            if last[p] >= 0:
                chain = set(self._chain(tail, last, p))
                shared = chain if shared is None else shared & chain
        if not shared:
            return [], (tail, tuple(last), before)
        cut = max(shared)[0]
        out = [t for _, t in reversed(self._chain(tail, last, cut))]
        return out, (tail[cut:], (-1, *last[cut + 1 :]), out[-1])

    def feed(self, state: State, data: bytes) -> tuple[bytes, State]:
        """Bytes in the middle of a word: packed tokens that are stable, next state."""
        out, size = [], self.v.lookahead
        for at in range(0, len(data), size):
            key = state, data[at : at + size]
            got = self.others.get(key)
            if got is None:
                ids, after = self.step(*key, False)
                if len(self.others) >= self.states:
                    self.others.clear()
                self.others[key] = got = array("I", ids).tobytes(), after
            out.append(got[0])
            state = got[1]
        return b"".join(out), state

    def close(self, state: State) -> bytes:
        return array("I", self.step(state, b"", True)[0]).tobytes()

    def word(self, word: str) -> bytes:
        """A whole word, from START to START."""
        got = self.old.get(word)
        if got is None:
            data, size = word.encode(), self.v.lookahead
            if len(data) > size:
                got, state = self.feed(START, data)
                return got + self.close(state)
            got = array("I", self.step(START, data, True)[0]).tobytes()
        if len(self.new) >= self.keep:
            self.old, self.new = self.new, {}
        self.new[word] = got
        return got


class Encoder:
    """Text in pieces to packed ids (little-endian unsigned 32-bit), the way the tokenizers library splits and merges it.

    Between pieces it keeps a transducer state and a few characters: at most `edge`, which is as far as the
    word pattern and a beginning added token can look ahead.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.machine = vocabulary, Transducer(vocabulary)
        self.words = regex.compile(PATTERN)
        self.added = regex.compile("|".join(regex.escape(a) for a in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None
        self.edge = max([4, *map(len, vocabulary.added)])
        self.runs = {kind: regex.compile(run) for kind, run in RUNS.items()}
        self.reset()

    def reset(self) -> None:
        self.carry, self.kind, self.state = "", "", START

    def _all(self, text: str) -> bytes:
        """Words from a word's start up to an end."""
        get, word = self.machine.new.get, self.machine.word
        return b"".join([get(w) or word(w) for w in self.words.findall(text)])

    def _continued(self, text: str, last: bool) -> tuple[bytes, str]:
        """What of the text goes on with the word that the last piece left open: its ids, and the rest."""
        run = self.runs[self.kind].match(text).end()
        if run == len(text) and not last:
            run = max(0, run - self.edge)
            out, self.state = self.machine.feed(self.state, text[:run].encode())
            return out, text[run:]
        if self.kind == "blank" and run < len(text):
            run -= 1  # the last blank goes with the word after it
        out, self.state = self.machine.feed(self.state, text[:run].encode())
        out += self.machine.close(self.state)
        self.kind, self.state = "", START
        return out, text[run:]

    def _plain(self, text: str, last: bool) -> tuple[bytes, str]:
        """Text without added tokens: ids, and the characters that wait for more."""
        out = b""
        if self.kind:
            out, text = self._continued(text, last)
            if self.kind:
                return out, text
        if last:
            return out + self._all(text), ""
        if len(text) <= self.edge:
            return out, text
        # The last match that begins before the edge: the words before it are what they are.
        cut = BLANKS.search(text, 0, len(text) - self.edge)
        at = cut.start() if cut and cut.end() < len(text) - self.edge else 0
        out += self._all(text[:at])  # whole words, as none goes over the beginning of a run of blanks
        for m in self.words.finditer(text, at):
            if m.end() + self.edge > len(text):
                break
            out += self.machine.new.get(m[0]) or self.machine.word(m[0])
            at = m.end()
        rest = text[at:]
        if len(rest) > 2 * self.edge and rest == self.words.match(rest)[0]:  # one word, and it goes on
            self.kind = next(k for k, r in self.runs.items() if r.fullmatch(rest[1:]))
            more, rest = self._continued_from(rest)
            out += more
        return out, rest

    def _continued_from(self, rest: str) -> tuple[bytes, str]:
        run = len(rest) - self.edge
        out, self.state = self.machine.feed(START, rest[:run].encode())
        return out, rest[run:]

    def feed(self, piece: str, last: bool = False) -> bytes:
        """A piece of a text in; ids out that no later piece can change. `last` ends the text."""
        text, out, self.carry = self.carry + piece, [], ""
        held = ""
        if self.added is not None:
            while (m := self.added.search(text)) is not None:
                out += [self._plain(text[: m.start()], True)[0], array("I", [self.v.added[m[0]]]).tobytes()]
                text = text[m.end() :]
            if not last:
                n = max((n for a in self.v.added for n in range(1, len(a)) if text.endswith(a[:n])), default=0)
                text, held = text[: len(text) - n], text[len(text) - n :]
        got, rest = self._plain(text, last)
        self.carry = rest + held
        out.append(got)
        return b"".join(out)

    def encode(self, text: str, piece: int = 1 << 15) -> Iterator[bytes]:
        """One whole text, `piece` characters at a time."""
        self.reset()
        for at in range(0, max(len(text), 1), piece):
            yield self.feed(text[at : at + piece] if at or len(text) > piece else text, at + piece >= len(text))


class Decoder:
    """Ids to text, piece by piece; its state is an unfinished code point."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, piece: int = 1 << 15) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every row, whole texts; null counts as empty.

    Encodes without special tokens added (their strings in a text are the special tokens, as the library
    has it) and decodes the ids as they come out, `piece` characters at a time; digests grow along, so
    besides the Arrow batch and, if asked for, the ids, nothing that grows with a text is kept. A narrow
    pass: no exchange; only doc_id and text are read; repeated ids are rows of their own; an empty table
    gives an empty result.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in slices(parts):
            n, sha, back, ids = [], [], [], []
            for value in batch.column("text"):
                decoder, packed_sha, text_sha, count = Decoder(e.v), hashlib.sha256(), hashlib.sha256(), 0
                for packed in e.encode(value.as_py() or "", piece):
                    packed_sha.update(packed)
                    text_sha.update(decoder.feed(array("I", packed)).encode())
                    count += len(packed) // 4
                    if with_ids:
                        ids.append(packed)
                text_sha.update(decoder.finish().encode())
                n.append(count)
                sha.append(packed_sha.hexdigest())
                back.append(text_sha.hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
