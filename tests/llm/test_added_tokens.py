"""Record ids against Tokenizer.encode on texts that hold an added token's string."""

import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from inkwell.llm import pretoken, records, vectext

END = "<|endoftext|>"
TEXTS = [f"a {END} b", "", END, END + END, None, f"it{END}'s  {END}  é", "<|endof", "text|>", f"x<|endof{END}text|>", "plain  text"]


def test_added_tokens_have_their_ids(spark):
    file = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    for limit in (1, 20, 1 << 20):
        got = []
        for chunk in vectext.chunks(pa.array(TEXTS), limit=limit):
            ids, bounds = pretoken.full_encoder(file).chunk_ids(chunk)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == want
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_tokens"] for r in records.token_records(docs, file).collect()}
    assert out == {i: len(ids) + 1 for i, ids in enumerate(want)}
