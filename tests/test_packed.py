import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from capsidora.operators.packed import split_block, split_one, split_packed

PIECES = ["Viruses", "a b", "O'x's", ";", ",", "|", ">", " / ", "/", "\t", " ", '"', "'", '""', "(", ")", "a; b", "GO:9000001", "GO:9000002 (x, y)", "PF90001.2:Spike; stalk", "[", "]", "é", "\\", "n/a", "-", "\n"]


def values(text, anchor=None):
    got = split_block(pa.array([text], pa.string()), anchor).to_pylist()[0]
    assert got == split_one(text, anchor)
    return got


def test_plain_values():
    assert values('Viruses; A/B complex > "x; y",\'z | w\' / u\tv') == ["Viruses", "A/B complex", "x; y", "z | w", "u", "v"]
    assert values('"J ""short"" clade" / Wexxen\'s cluster;;') == ['J "short" clade', "Wexxen's cluster"]
    assert values('["a, b", "c \\"d\\""]') == ["a, b", 'c "d"']
    assert values("a (in part; unranked); b") == ["a (in part; unranked)", "b"]
    assert values('a; "b') == ["a", '"b']
    assert [values(x) for x in ("", "  ", "n/a", "NA", "[]", "-", " none ", '"n/a"')] == [[]] * 8


def test_anchored_values():
    assert values('GO:9000001 (matrix, late) "GO:9000002~x; y" GO:9000003', "GO:") == ["GO:9000001 (matrix, late)", "GO:9000002~x; y", "GO:9000003"]
    assert values("'PF90001:Capsid, N-term'|PF90002.1:Helicase C-lobe\nPF90003;", "PF") == ["PF90001:Capsid, N-term", "PF90002.1:Helicase C-lobe", "PF90003"]
    assert values("none", "GO:") == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), min_size=1, max_size=6), st.sampled_from([None, "GO:", "PF"]))
def test_blocks_agree_with_the_scanner(texts, anchor):
    assert split_block(pa.array(texts, pa.string()), anchor).to_pylist() == [split_one(t, anchor) for t in texts]


def test_table(spark):
    rows = [("a", "x; y", 1), ("a", "x; y", 2), ("b", None, 3), (None, "z", 4), ("c", "n/a", 5), ("d", "v;" * 5000, 6)]
    df = spark.createDataFrame(rows, "id string, t string, value int")
    got = split_packed(df, "id", {"t": None}).collect()
    assert sorted(tuple(r) for r in got if r.record_id != "d") == [("t", "a", 1, "x"), ("t", "a", 2, "y")]
    assert sum(r.record_id == "d" for r in got) == 5000
    assert split_packed(df.limit(0), "id", {"t": None}).count() == 0
