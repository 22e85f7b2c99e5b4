"""The pipeline against its plain versions in a chain, and its stages on awkward tables."""

import base64

import plain
import pytest
import tiktoken

import public_tokenizers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    return dict(__import__("corpus_pipeline").STAGES)


def test_pipeline_equals_the_plain_chain(spark):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).orderBy("doc_id").collect()]
    rows = [r for r, (_, kept) in zip(rows, plain.verdicts(rows)) if kept]
    label = plain.classes([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    rows = [r for r in rows if not plain.contaminated(r[1], items)]
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r[0], *plain.encoded(plain.masked(r[1]), library)) for r in rows)
    out = corpus_pipeline.run(spark, SF)
    assert want and sorted(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "encoding"])
def test_stages_on_awkward_tables(spark, stages, name):
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    prose = "some words that make a sentence of more than ten words in a row here"
    rows = [(1, prose, "en", "s", 3), (1, prose, "en", "s", 3), (None, prose + " and more of it", None, None, None), (2, None, None, "s", 0), (3, "", "en", None, 0), (4, long, "en", "s", 1), (4, "another text " + prose[::-1], "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, __found string, __statistics string, __key string, __hash int, blob string, n int, m_0 double, lang_source string"
    docs = spark.createDataFrame([(*r, "f", "s", "k", 7, "b", 1, 0.5, "ls") for r in rows], kinds)
    out = stages[name](spark, docs, SF)
    got = out.collect()
    if name == "encoding":
        assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got)[:2] == [0, 0]
        return
    assert out.columns == docs.columns and all(r["__found"] == "f" and r["lang_source"] == "ls" and r["n"] == 1 for r in got)
    texts = sorted((r["text"] or "")[:20] for r in got)
    whole = sorted((r[1] or "")[:20] for r in rows)
    if name == "near_duplicates":  # a repeated row goes; a null text and an empty one are copies; the longer prose is too far from the shorter
        assert len(got) == len(plain.np.unique(plain.classes([r[1] for r in rows])))
    elif name == "quality_rules":
        assert set(texts) - {long[:20]} == {t for t in whole if t} - {long[:20]}
    else:
        assert texts == whole
    assert stages[name](spark, docs.where("false"), SF).count() == 0
