"""Words of any letters are encoded many at a time, with the ids of whole texts."""

import pyarrow as pa

from tracewell.llm import token_store
from tracewell.llm.common import text_buffer


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_letters_go_in_groups():
    encoder = token_store.Encoder(token_store.vocabulary())
    whole, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    words = [f"é{chr(97 + i % 26)}{chr(97 + i // 26)}日" for i in range(600)]
    texts = [" ".join(words), "İstanbul क़ ﬁne ǅ 한글 ª Ⅷ x́ é́ a b 　 naïve, o'é é|É |x|Y a|B", "| é", ""]
    ids, offsets = encoder(*text_buffer(pa.array(texts[:1])))
    assert encoder.tokenizer.texts <= 10
    for t in texts:
        ids, _ = encoder(*text_buffer(pa.array([t])))
        assert ids[:-1].tolist() == whole.encode(t, add_special_tokens=False).ids
