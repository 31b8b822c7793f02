"""Token ids by many texts at once: calls of the library, odd texts, full dictionaries, and the choice of words of a block."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import token_output
from lectern.llm.queries import tokenizer_path

ODD = [None, "", " \t\n", "word " * 3_000, "Été, don't  WE'LL 12½ _a_ <|endoftext|>", "İstanbul ΣΑΣ 日本語 é a b\x1cc\x85d", "</w> a</w>b", "x" * 5_000, " last\v"]


class Counted:
    """A tokenizer or its model whose encoding calls are counted."""

    def __init__(self, own, calls):
        self.own, self.calls = own, calls

    def __getattr__(self, name):
        found = getattr(self.own, name)
        if name == "model":
            return Counted(found, self.calls)
        if name.startswith(("encode", "tokenize")):
            self.calls.append(name)
        return found


def unseen(n):
    """n words that no other holds, of letters alone."""
    return ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "qu" for i in range(n)]


@pytest.fixture(scope="module")
def whole():
    own = Tokenizer.from_file(tokenizer_path())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_unseen_words_share_calls(whole):
    code, calls, text = token_output.Encoder(tokenizer_path()), [], " ".join(unseen(3_000))
    code.tokenizer = Counted(code.tokenizer, calls)
    if hasattr(code, "model"):
        code.model = Counted(code.model, calls)
    assert np.frombuffer(code(text), "<u4").tolist() == whole(text)
    assert len(calls) <= 3


@pytest.mark.parametrize(("most", "together", "at_once"), [(350_000, 4_000_000, 50_000), (5, 4_000_000, 50_000), (5, 10, 2)])
def test_many_texts_encode_as_whole(whole, monkeypatch, most, together, at_once):
    monkeypatch.setattr(token_output, "_TOGETHER", together)
    monkeypatch.setattr(token_output, "_AT_ONCE", at_once)
    code = token_output.Encoder(tokenizer_path(), most)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before", *ODD, *unseen(40), *ODD], kind).slice(1)
        assert [x.tolist() for x in code.many(column)] == [whole(x) for x in column.to_pylist()]
        assert not list(code.many(column.slice(0, 0)))
    assert len(code.pieces) <= max(most, 1) and len(code.parts) <= max(most, 1)


def words_one_by_one(ids):
    """The selectors of a block, each tried in turn at its place."""
    i, out = 0, []
    while i < len(ids):
        for s, (n, w) in enumerate(zip(token_output.COUNTS, token_output.WIDTHS, strict=True)):
            own = ids[i : i + n]
            if s == 15 or (own == [1] * n if s < 2 else all(x < 1 << w for x in own)):
                out.append(s)
                i += n
                break
    return out


@pytest.mark.parametrize("bits", [1, 3, 9, 16, 31, 33, 60, 63])
def test_block_takes_most_values(bits):
    random = np.random.default_rng(bits)
    for _ in range(20):
        ids = random.integers(0, 2**bits, int(random.integers(1, 600)), dtype=np.uint64) >> random.integers(0, bits + 1, 1).astype(np.uint64)
        ids[random.random(len(ids)) < 0.5] = 1
        ids[: int(random.integers(0, len(ids)))] = 1
        words = token_output.encode_block(ids)
        assert (token_output.decode_block(words, len(ids)) == ids).all()
        heads, i = [], 0
        while i < len(words):
            heads.append(int(words[i]) >> 60)
            i += 1 + (heads[-1] == 15)
        assert heads == words_one_by_one(ids.tolist())
