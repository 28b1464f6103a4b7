import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

CLASHING = ["key", "class", "row", "n", "length", "digest", "h", "v", "_text", "ids", "no", "label",
            "_spans", "_blob", "blob", "spans", "address", "found", "_row", "_checked", "sequence_id", "offset", "items", "words", "starts"]


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text): null, empty and white-space texts, ties, repeats, specials, secrets, near copies, one long text."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:60])
    near = " ".join(words[:57] + ["x", "y", "z"])
    chain = " ".join(words[:54] + ["x", "y", "z", "p", "q", "r"])
    texts = [
        None, "", "   \n\t ", "a", "a", " a ", "one two three", "ONE two\tthree", base, base, base.upper(), near, chain,
        "İstanbul ß é é 你好 😀 <|endoftext|> don't can've 'tis", "x" * 3000, "'r 're 'v\n's  \n\n z",
        'password: "abc" token=secret:hunter22 API_KEY = q1w2e3 AKIA' + "A1" * 9 + " " + "deadbeef" * 4,
        "AKIA" + "Z" * 15 + " token=" + "0123456789abcdef" * 2, " ".join(words * 60), "　 tail x",
    ]
    rows = list(enumerate(texts))
    return rows + [(50, base), (51, near + " t"), (52, "you are a complete idiot and a loser")]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts with extra columns whose names the operators use themselves."""
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(k, t, *([None] * len(CLASHING))) for k, t in odd_texts], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
