"""The tokenizers library gets each piece of a text once, whatever signs follow it."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

from newslake.llm import bpe
from newslake.llm.queries import BYTE_BPE, WORD_BPE


class Counted:
    def __init__(self, whole: Tokenizer):
        self.whole, self.signs = whole, 0

    def __getattr__(self, name):
        def call(texts, **options):
            self.signs += sum(map(len, texts))
            return getattr(self.whole, name)(texts, **options)

        return call


@pytest.mark.parametrize("kind,path", [("byte", BYTE_BPE), ("word", WORD_BPE)])
def test_library_sees_a_piece_once(kind, path):
    own, whole = bpe.Encoder(path, kind == "word"), Tokenizer.from_file(path)
    own.whole = Counted(own.whole)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}ü" for i in range(400)]
    texts = [" ".join(w + s for w in words) for s in ("###", "***", "$$$", ",", "%%%", "")]
    assert [x.tolist() for x in own.encode_batch(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.whole.signs < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("kind,path", [("byte", BYTE_BPE), ("word", WORD_BPE)])
def test_pieces_that_may_not_be_cut(kind, path):
    own, whole = bpe.Encoder(path, kind == "word"), Tokenizer.from_file(path)
    texts = ["İ. ßsİ<!", "a<|endoftext|>b. c", "a <|startoftext|>.", "a \0b. \0", "it's. a.'s \x01", "é́! x̸> a.\n\n B", "漢字. ", ""]
    assert [x.tolist() for x in own.encode_batch(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_skip_the_steps_before_the_model():
    own, whole = bpe.Encoder(WORD_BPE, True), Tokenizer.from_file(WORD_BPE)
    own.whole = Counted(own.whole)
    words = [f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}{b}" for i in range(100) for a, b in (("Wort", "ü"), ("ßÀ", "ERLY"), ("ñÞ", ""), ("ofth", "ÿ" * (i % 7)))]
    texts = [" ".join(words), "x" * 5000 + "É" * 5000, "zu\nZu zu"]
    assert [x.tolist() for x in own.encode_batch(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.whole.signs == 0
    # marks that compose with a small letter alone or a large one, signs lowered to others, digits, letters that are no words of their own
    odd = ["h\u0331 H\u0331 J\u030c j\u030c T\u0308h e\u0301 E\u0301a", "İstanbul ıI \u212aelvin ſo ÅÅ ªº µm ÷× Ǆ ΑΣ ΑΣa", "a1b2 ab\u00adc ab\u200bc ab\u0301c nbsp\u00a0nbsp", "'S O'RE ''s x</w> </w>y"]
    assert [x.tolist() for x in own.encode_batch(odd)] == [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]
