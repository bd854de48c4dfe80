"""The pipeline against a brute-force version on a small table."""

import corpus_pipeline
import public_tokenizers
import tiktoken

from factloom.llm import bpe
from tests.llm.test_documents import near_truth, variants


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    texts = [f"the house of the {w}" for w in ("king", "queen", "cat")] + variants(8)
    texts += [texts[4], texts[0], None, "", "12 34", "der mann und die frau"]
    rows = [(i, t, "de" if t and t.startswith("der") else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    single = [i for i in known if i == max(j for j in known if texts[j] == texts[i])]
    want, _ = near_truth([texts[i] for i in single], 5, 80)
    kept = {single[i] for i in want if want[i] == i}
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in result} == kept
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(file.read()), special_tokens={})
    assert all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in result)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "bpe"]
