import random

import pytest
from pyspark.sql import functions as F

#: Texts that operators tend to stumble on; the last is long.
ODD = [None, "", " ", "\n", "a", "a\n\nA \n", "word " * 3, "  lead", "trail  ", "a\x1cb\x1d\x85c d e　f\x00g", "▁ ▁▁ <s> </s> <unk> <|endoftext|>", "héllo 日本語 🙂🙂 ß", "x" * 5000, "don't we'll I'VE 1234 $$$ ...", "a" * 30 + " " * 40 + "b", "same words here " * 40, "tab\tand\x0bvt\r\nend", "long words follow " * 20000]
#: Names that the operators use inside or give to their own columns.
CLASHING = "id f g n key node p k t i _k _t _h _l _p _row _body _words _w _sum _html _drop _lines _kept n_tokens n_bytes ids decoded score predicted kept n_words base_failed spans base n_lines n_dropped component_id value count".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """ODD twice (repeated rows), one row with a null id, and extra columns with clashing names."""
    rows = [(k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + rows[:6] + [(None, "no id at all")], "doc_id long, text string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def random_texts():
    rng = random.Random(1)
    alphabet = "abc ABC  12\n\t'.,!▁éß日🙂  \x1c\x85#$<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="session")
def keeps_columns():
    def check(out, docs, without=()):
        """Carried columns hold their own values, and no row was lost."""
        rows = out.collect()
        assert len(rows) == docs.count()
        for c in set(CLASHING) - set(without):
            assert {r[c] for r in rows} == {f"own {c}"}, c
        return rows

    return check
