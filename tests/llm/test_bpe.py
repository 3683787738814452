"""The streaming transducer against plain merging and against the tokenizers library; bounded memory."""

import hashlib
import json
import tracemalloc
from array import array

import numpy as np
import pytest

from pilefold.llm import bpe
from pilefold.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def made_up(folder, rng, merges: int) -> str:
    """A file of the byte alphabet and a random merge list over a, b, c, in which each merge joins two tokens that are there."""
    letters = {b: c for c, b in bpe._byte_letters().items()}
    tokens, pairs = ["a", "b", "c"], []
    while len(pairs) < merges:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if (a, b) not in pairs and len(a + b) <= 12:
            pairs.append((str(a), str(b)))
            if a + b not in tokens:
                tokens.append(str(a + b))
    vocabulary = {t: i for i, t in enumerate([*(letters[b] for b in range(256)), *(t for t in tokens if len(t) > 1)])}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    file = {"added_tokens": [], "normalizer": None, "pre_tokenizer": level, "decoder": level, "model": {"type": "BPE", "vocab": vocabulary, "merges": [list(p) for p in pairs]}}
    path = folder / f"{rng.integers(1 << 40)}.json"
    path.write_text(json.dumps(file))
    return str(path)


def merged(v: bpe.Vocabulary, word: bytes) -> list[int]:
    return v._merged([v.id_of[word[k : k + 1]] for k in range(len(word))])[0]


def test_lookahead_of_random_merge_lists(tmp_path):
    """Fed byte by byte, with a lookahead as small as the longest token, the transducer emits what merging the whole word gives."""
    rng = np.random.default_rng(7)
    emitted = 0
    for _ in range(60):
        v = bpe.Vocabulary(made_up(tmp_path, rng, int(rng.integers(1, 40))))
        assert v.lookahead == max(len(v.bytes_of[new]) for _, new in v.rank.values())
        for _ in range(12):
            word = bytes(rng.choice(list(b"abc"), rng.integers(1, 160)).tolist())
            machine, state, out = bpe.Transducer(v), bpe.START, []
            for k in range(len(word)):
                ids, state = machine.step(state, word[k : k + 1], False)
                out += ids
                assert len(state[0]) <= 5 * v.lookahead or len(set(word)) == 1 or not ids
            emitted += len(out)
            assert out + machine.step(state, b"", True)[0] == merged(v, word)
            assert machine.word(word.decode()) == array("I", merged(v, word)).tobytes()
    assert emitted > 1000  # most tokens come out before the end


def test_pieces_and_open_words(library):
    """Any cut of the text, words longer than a piece, blanks, contractions and added tokens at the borders."""
    e, rng = bpe.encoder(tokenizer_path()), np.random.default_rng(0)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "日本", "🎉", "12", "'s", "'", "'re", "!!", "<|endoftext|>", "<|end", "zzzz", "́", "\xa0", "a" * 40, " " * 30, "\n" * 25, "9" * 33, "!?" * 20, "日" * 30]
    for _ in range(500):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        n = int(rng.integers(1, 30))
        want = array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        assert b"".join(e.encode(text, n)) == want == b"".join(e.encode(text))
    for text in ("a" * 3000, "thethe" * 500, "é" * 1500, " " * 700, "!" * 900, "x" * 500 + "'s", " " * 300 + "x"):
        want = array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        assert all(b"".join(e.encode(text, n)) == want for n in (1, 7, 64, 1000, 5000))


def test_memory_does_not_grow_with_the_text():
    """A word of 4 million characters and a text of many words: what is kept beside the text stays small."""
    e = bpe.encoder(tokenizer_path())
    for text in ("abcdefgh" * 500_000, "some words, 12 of them; " * 160_000):
        tracemalloc.start()
        digest, most = hashlib.sha256(), 0
        for packed in e.encode(text):
            digest.update(packed)
            most = max(most, len(e.carry) + len(e.state[0]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most <= 6 * e.v.lookahead and peak < 12_000_000


def test_other_files_are_refused(tmp_path):
    file = json.load(open(made_up(tmp_path, np.random.default_rng(1), 3)))
    path = tmp_path / "other.json"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": file["model"] | {"end_of_word_suffix": "</w>"}}, {"added_tokens": [{"content": "<x>", "id": 300, "lstrip": True}]}):
        path.write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))
