"""Text expressions, readers and writers on hand-made lines."""

import os

import pytest
from pyspark.sql import functions as F

from logweir.functions import sequences as S, text as T
from logweir.operators import dictionaries as D, parsing as P
from logweir.session import fresh_path
from logweir.sources import readers as R, writers as W


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_collapse_wildcards(spark):
    c = F.col("t")
    assert one(spark, T.collapse_wildcards(c), t="a <*><*> <*> b") == "a <*> <*> b"
    assert one(spark, T.collapse_wildcards(c, True), t="a <*><*> <*> b") == "a <*> b"


@pytest.mark.parametrize("content,want", [("open /x by root", ["/x", "root"]), ("close /x", [])])
def test_literal_parameters(spark, content, want):
    assert one(spark, T.extract_params_literal(F.col("c"), F.col("t")), c=content, t="open <*> by <*>") == want


def test_literal_parameters_without_wildcard_and_with_adjacent(spark):
    f = T.extract_params_literal(F.col("c"), F.col("t"))
    assert one(spark, f, c="abc", t="abc") == []
    assert one(spark, f, c="id 7 end", t="id <*> end") == ["7"]
    assert one(spark, f, c="xyz", t="x<*>") == ["yz"]


def test_regex_parameters(spark):
    f = T.extract_params_regex(F.col("c"), F.col("t"))
    assert one(spark, f, c="Took 10.5 s (max)  for  blk_77", t="Took <*> s (max)  for  blk_<*>") == ["10.5", ""]
    assert one(spark, f, c="no match", t="Took <*> s") == []
    assert one(spark, f, c="plain", t="plain") == []
    loose = T.extract_params_regex(F.col("c"), F.col("t"), mask_blocks=False, loose=True)
    assert one(spark, loose, c="user=root, id 5!", t="user <*> id <*> end") == []
    assert one(spark, loose, c="open:root, now", t="open <*> now") == ["root,"]


def test_python_like_number_tests(spark):
    cases = {"1": (True, True), "1.0": (True, True), "1.5": (True, False), "1e3": (True, True), "x": (False, False), "nan": (True, False),
             "inf": (True, False), "1d": (False, False), "1_000": (True, True), "": (False, False), ".5": (True, False), "5.": (True, True)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (r.f, r.i) for r in df.select("t", T.is_float(F.col("t")).alias("f"), T.is_int(F.col("t")).alias("i")).collect()}
    assert got == cases


def test_tokenisers(spark):
    assert one(spark, T.tokenize_ws(F.col("t")), t="  a\t b c  ") == ["a", "b", "c"]
    assert one(spark, T.tokenize_ws(F.col("t")), t="   ") == []
    assert one(spark, T.tokenize_punct(F.col("t")), t="a b:c, <*>=\\d; ") == ["a b", "c", " <*>", "\\d"]


def test_masks(spark):
    text = "Receiving blk_-42 from /10.0.0.1:50 in /var/log-a/x at 0xfF"
    assert one(spark, T.mask_variables(F.col("t"), T.HDFS_MASKS), t=text) == "Receiving blk_<*> from /<*>:50 in <*> at 0xfF"
    assert one(spark, T.mask_variables(F.col("t"), T.BGL_MASKS), t="id 12345678 x") == "id <*> x"
    assert one(spark, T.mask_variables(F.col("t"), T.BGL_MASKS_ESCAPED), t="a 1.2.3.4 b 0x1f") == "a <*> b <*>"


def test_placeholders(spark):
    assert one(spark, T.placeholder_to_unk(F.col("t")), t="blk_<*> at <*>") == "blk_[UNK] at [UNK]"
    assert one(spark, T.placeholder_to_unk(F.col("t"), True), t="blk_<*> at <*>") == "blk_<*> at [UNK]"


def test_format_with_optional_text_and_marks(spark):
    rows = [(0, " 081109 203518 143 INFO dfs.DataNode: Receiving: blk_1 "), (1, "broken"), (2, "1 2 3 W a.b:  tail\x1fmark")]
    log = P.parse_log_format(spark.createDataFrame(rows, "line_no bigint, line string"), T.HDFS_FORMAT)
    got = {r.line_id: (r.Component, r.Content) for r in log.collect()}
    assert got == {1: ("dfs.DataNode", "Receiving: blk_1"), 2: ("a.b", "tail\x1fmark")}


def test_log_time(spark):
    assert one(spark, T.parse_log_time(F.col("t"), "yyyy-MM-dd-HH.mm.ss.SSSSSS"), t="2005-06-03-15.42.50.675872") == 1117813370
    assert one(spark, T.parse_log_time(F.col("t"), "yyyy.MM.dd HH:mm:ss"), t="1970.01.02 00:00:01") == 86401


def test_lines_come_back_in_file_order(spark, tmp_path):
    for name, lines in (("b.log", ["b1", "", "b3"]), ("a.log", [f"a{i}" for i in range(500)])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = [r.line for r in R.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
        numbers = [r.line_no for r in R.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(500)] + ["b1", "", "b3"]
    assert numbers == list(range(503))


def test_sequences_round_trip_and_parts(spark):
    rows = [("s1", p, f"e{p}", 5, 0) for p in range(5)] + [("s2", 0, "x", 1, 9)]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, event string, n_events bigint, first_line bigint")
    parts = {(r.session_id, r.part): r.line for r in W.sequence_lines(df, ["event"], segment=2).collect()}
    assert parts == {("s1", 0): "e0 e1", ("s1", 1): "e2 e3", ("s1", 2): "e4", ("s2", 0): "x"}
    path = W.write_sequence_text(df, ["event"], fresh_path(spark, "t"), ["first_line"])
    assert {(r.session_id, r.pos, r.event) for r in R.read_sequences(spark, path).collect()} == {(0, p, f"e{p}") for p in range(5)} | {(1, 0, "x")}
    with pytest.raises(ValueError):
        W.write_sequence_text(df, ["event"], fresh_path(spark, "t"), ["first_line"], segment=2)


def test_sequence_tokens_with_times(spark):
    df = spark.createDataFrame([(0, "7,3.5 8,2.0 9"), (1, " 4 ")], "line_no bigint, line string")
    got = [tuple(r) for r in R.parse_sequences(df).orderBy("session_id", "pos").collect()]
    assert got == [(0, 0, "7", 0.0, 3), (0, 1, "8", 2.0, 3), (0, 2, "9", 0.0, 3), (1, 0, "4", 0.0, 1)]


def test_structured_csv_keeps_text(spark):
    rows = [("081109", 'say "hi", NA', "", "a\\b")]
    path = W.write_structured_csv(spark.createDataFrame(rows, "Date string, Content string, Level string, X string"), fresh_path(spark, "csv"))
    assert [tuple(r) for r in R.read_structured_csv(spark, path, ["Date", "Content", "Level", "X"]).collect()] == rows


@pytest.mark.parametrize("small", [0, 1000])
def test_vocabulary(spark, small):
    df = spark.createDataFrame([(t,) for t in "b a a c b a".split()], "event string")
    vocab = D.build_vocab(df, small=small)
    assert [r.token for r in vocab.orderBy("idx").collect()] == ["<pad>", "<unk>", "<eos>", "<sos>", "<mask>", "a", "b", "c"]
    other = D.build_vocab(spark.createDataFrame([(t,) for t in "z z y c".split()], "event string"), small=small)
    assert [r.token for r in D.extend_vocab(vocab, other, small=small).orderBy("idx").collect()][8:] == ["z", "y"]
    assert [r.token for r in D.extend_vocab(vocab, other, sort=True, small=small).orderBy("idx").collect()][8:] == ["y", "z"]


def test_encode_decode_round_trip(spark):
    rows = [("s", p, e, 3) for p, e in enumerate("abq")]
    df = spark.createDataFrame(rows, "session_id string, pos bigint, event string, n_events bigint")
    vocab = D.build_vocab(df.where("event <> 'q'"))
    ids = D.encode_sequence(df, vocab, 7, with_eos=True, with_sos=True)
    assert [r.idx for r in ids.orderBy("pos").collect()] == [3, 5, 6, 1, 2, 0, 0]
    assert {r.origin_len for r in ids.collect()} == {5}
    assert [r.token for r in D.decode_sequence(ids, vocab, drop_pad=True).orderBy("pos").collect()] == ["<sos>", "a", "b", "<unk>", "<eos>"]
    assert [r.idx for r in D.encode_sequence(df, vocab, 2).orderBy("pos").collect()] == [5, 6]


def test_similarity(spark):
    f = S.template_similarity(F.col("a"), F.col("b"))
    assert one(spark, f, a=["x", "<*>", "z"], b=["x", "<*>", "y"]) == pytest.approx(1 / 3)
    assert one(spark, S.merge_template(F.col("a"), F.col("b")), a=["x", "y"], b=["x", "z"]) == ["x", "<*>"]


def test_repository_holds_no_data():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    big = [f for d, _, fs in os.walk(root) if ".git" not in d for f in fs if os.path.getsize(os.path.join(d, f)) > 1_000_000]
    assert not big


def test_masks_cover_other_scripts(spark):
    assert one(spark, T.mask_variables(F.col("t"), T.HDFS_MASKS), t="in /données/été ok") == "in <*> ok"
    assert one(spark, T.mask_variables(F.col("t"), [r"\d+"]), t="n ٣٤ m") == "n <*> m"
