import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmill.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENC = Encoder(PATH)
SIGNS = st.sampled_from(list("ab'srtvemld 19\n\t.,!éß²½ 　́日ª_\x1c\x85 🙂") + ["'re", "  ", "<|endoftext|>", "it's"])


def same(texts):
    offs, ids = ENC.encode(texts)
    want = [ENC.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(SIGNS, max_size=14).map("".join), min_size=1, max_size=4))
def test_pieces_match_the_library(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=4))
def test_any_text(texts):
    same(texts)


def test_every_code_point():
    """Each by itself, after a letter, and between blanks."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(points), 1 << 16):
        some = points[k : k + (1 << 16)]
        for texts in (["".join(f"a{c} {c}b" for c in some[i : i + 4096]) for i in range(0, len(some), 4096)], ["".join(some)]):
            same(texts)


def test_given_texts(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(texts)
    offs, ids = ENC.encode(["", ""])
    assert offs.tolist() == [0, 0, 0] and ids.dtype == np.uint32
