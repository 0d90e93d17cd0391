"""Every verb on distributed values gives what it gives on local arrays, whatever the partitions and the order's kind."""

import re

import numpy as np
import pytest

from pleat import Table, apl, j
from pleat.errors import NotYet
from pleat.plans import blocks

SENTENCES = [
    "+/ {x}", "(+/ % #) {x}", "%: (+/ d * d) % # d =. {x} - (+/ % #) {x}", "{x} > 5", "({x} > 5) # {x}", "+/\\ {x}", ">./\\ {x}", "-/\\ {x}", "+/\\. {x}", "3 +/\\ {x}", "(3 +/\\ {x}) % 3", "_6 +/\\ {x}", "3 (+/ % #)\\ {x}", "{k} +//. {x}",
    "{k} (+/ % #)/. {x}", "{k} #/. {x}", "{k} {./. {x}", "~. {k}", "~: {k}", "{k} i. 2 7 0", "2 0 1 i. {k}", "{k} e. 0 2", "{x} -. 5 7", "{x} -. {k}", "5 {. \\:~ {x}", "/: {x}", "|. {x}", "3 |. {x}", "3 }. {x}", "_3 {. {x}", "25 {. {x}",
    "(1 }. {x}) - _1 }. {x}", "{b} +/;.1 {x}", "{b} +/;._2 {x}", "{b} +/;.2 {x}", "2 4 6 I. {x}", "{x} I. {k}", "3 | {k}", "{k} +. 4", "3 2 1 p. {x}", "2 +/\\. {x}", "([ + 0.5 * ])/\\. {x}", "([ + 0.5 * ])/\\ {x}", "([ + 0.5 * ])/ {x}", "99 (2 5)} {x}",
    "{x} , {k}", "<./ {x}", "{x} -: {x}", "7 4 1 E. {x}", "I. {b}", "|.!.0 {x}", "{x} +/ 1 2 3", "2 3 { {x}", "+/ {x} * {x}", "4 5 $ {x}", "+/\"1 (4 5 $ {x})", "#\\ {x}", "(+/ % #)\\ {x}", "- {x}", "{x} = {k}", "1 + {k} * 2", "(-: {x}) <. 3",
    "{k} { 10 20 30", "-/ {x}", "*./ {b}", "+./ {b}", "~:/ {b}", "{k} 22 b. 3", "(-: ` +: @. (>&5)) {x}", "{x} /: {k}", "{k} i: 1", "2 * 3 + {x}", "(- 3&|) {k}", "({x} > 2) +/;.1 {x}",
]
SECOND = ["+/{x}", "(+/÷≢){x}", "({x}>5)/{x}", "3+/{x}", "+\\{x}", "⌈\\{x}", "⍋{x}", "∪{k}", "⍸{b}", "{k}∊0 2", "{x}~5 7", "2↑{x}", "¯3↓{x}", "⌽{x}", "1⌽{x}", "⌊/{x}", "{⍵-⌊/⍵}{x}", "{x}÷10", "2|{k}", "{k}∪5 6 {y}"[:9]]


@pytest.fixture(scope="module")
def tables(spark):
    data = [(i, float((i * 7) % 10), i % 3, (i * 5) % 4 == 0) for i in range(20)]
    df = spark.createDataFrame(data, "p long, x double, k long, b boolean")
    local = {"x": np.array([r[1] for r in data]), "k": np.array([r[2] for r in data]), "b": np.array([r[3] for r in data])}
    return {"dense": Table(df.repartition(3), pos="p"), "sorted": Table(df.repartition(5), order=["p"]), "single": Table(df.coalesce(1), pos="p")}, local


def numbers(text):
    return [round(float(w.replace("_", "-").replace("¯", "-")), 6) if re.fullmatch(r"[_¯]?[\d.]+(e_?\d+)?", w) else w for w in text.split()]


def check(language, sentence, tables, how):
    frames, local = tables
    names = [n for n in local if f"{{{n}}}" in sentence]
    want = str(language(sentence, {n: local[n] for n in names}))
    got = str(language(sentence, {n: frames[how][n] for n in names}))
    assert numbers(got) == numbers(want)


@pytest.mark.parametrize("sentence", SENTENCES)
def test_first_notation(tables, sentence):
    check(j, sentence, tables, "dense")


@pytest.mark.parametrize("sentence", SENTENCES[::3])
def test_ordered_by_a_column(tables, sentence):
    check(j, sentence, tables, "sorted")


@pytest.mark.parametrize("sentence", [s for s in SECOND if "{y" not in s and "∪5" not in s])
def test_second_notation(tables, sentence):
    check(apl, sentence, tables, "dense")


@pytest.mark.parametrize("sentence", ["+/\\ {x}", ">./\\. {x}", "3 +/\\ {x}", "(1 }. {x}) - _1 }. {x}", "|.!.0 {x}", "([ + 0.5 * ])/\\. {x}"])
def test_small_blocks(tables, sentence, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "SPAN", 8)
    monkeypatch.setattr(blocks, "VAST", 1)
    check(j, sentence, tables, "dense")


def plan_of(sentence, **values):
    return j(sentence, values).to_df("v")._jdf.queryExecution().executedPlan().toString()


def test_plans(tables, spark, tmp_path):
    frames, _ = tables
    frames["dense"].frame.df.write.parquet(str(tmp_path / "t"))
    t = Table(spark.read.parquet(str(tmp_path / "t")), pos="p", whole=True)
    plan = j("+/ {x} * {x}", {"x": t["x"]}).to_df("v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "ReadSchema: struct<x:double>" in plan
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,1)]" in plan_of("({x} > 1) # {x}", x=t["k"])
    assert plan_of("({k} +//. {x} * {x}) % {k} +//. {x}", k=t["k"], x=t["x"]).count("Exchange") == 1
    assert plan_of("m =. (3 +/\\ {x}) % 3\n(3 +/\\ *: {x}) - *: m", x=t["x"]).count("Exchange") == 1
    assert plan_of("a =. 1 }. _1 }. {x}\n(a > _2 }. {x}) *. a > 2 }. {x}", x=t["x"]).count("Window ") == 1
    assert plan_of("_5 +/\\ {x}", x=t["x"]).count("Exchange") == 1
    assert "Join" not in plan_of("4 {. \\:~ {x}", x=t["x"])
    looked = plan_of("({k} i. {a}) { {x}", k=t["p"], x=t["x"], a=t["k"])
    assert looked.count("Join") - looked.count("BroadcastExchange") <= 1
    scan = j("+/\\ {x}", {"x": t["x"]}).to_df("v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in scan  # block totals come back by a join, not by one window over all rows


def test_refusals(tables):
    frames, _ = tables
    x = frames["dense"]["x"]
    for sentence in ("(3 : 'y')/ {x}", "= {x}", "A. {x}", "{:: {x}"):
        with pytest.raises(NotYet):
            j(sentence, {"x": x})
    with pytest.raises(NotYet):
        j("+/\\ {x}", {"x": Table(frames["dense"].frame.df)["x"]}).to_df("v", pos="p")


MORE = [
    "! {x}", "2 ! {k}", "p: {k}", "q: 2 + {k}", "{x} j. {k}", "| {x} j. {k}", "+. {x} j. {k}", "+/ {x} j. {k}", "% {x} j. 1", "0 +/\\ {x}", "3 (3 : '(/:~ y) {~ 1')\\ {x}", "{k} (3 : '{. \\:~ y')/. {x}", "_5 (3 : '(<./ y) + # y')\\ {x}", "{b} (3 : '-/ y');.1 {x}",
    "3 -/\\ {x}", "(+/ % #) &.^. 1 + {x}", '(+/ % #)"0 {x}', "{x} ,: {k}", "~. 0.1 * {k}", "(0.1 * {k}) e. 0.2 0.3", "{x} */ {k}", "2 <\\ {k}", "2 #. {k}", "([ + 0.9 * ])/\\. {x}", "([ + _1 * ])/\\. {x}", "([ + 1.5 * ])/\\. {x}", "(19 }. {x}) + 20 +/\\ {x}", "30 {. ({x} > 5) # {x}",
    "8 o. {x}", "_25 {. {x}", "(3 }. {x}) - 4 +/\\ {x}", "(+/\\ {x}) - {x}", "({k} +//. {x}) % {k} #/. {x}",
]
MORE += ["{b} #^:_1 {b} # {x}", "; 3 <\\ {k}", "> 3 <\\ {k}", "L. 3 <\\ {k}", "3!:0 {x}", "9 (1 3 _1)} {x}", "(100 + i. 18) (i. 18)} {x}", "{x} %. (1 + 0 * {k}) ,. {k}", "(<. @ -:) ^: _ {k}"]
MORE_APL = ["A←{x} ⋄ A[2 3]←0 ⋄ A", "∊{k}⊂{x}", "(⌊÷∘2)⍣≡{k}", "¯2-/{x}", "¯3⌈/{x}", "{b}\\{b}/{x}", "{k}⊂{x}", "4 5⍴{x}", "{x}∘.+{k}", "≠{k}", "{k}~0", "{x}[1 3]"]


@pytest.mark.parametrize("sentence", MORE)
def test_more_of_the_first_notation(tables, sentence):
    check(j, sentence, tables, "dense")


@pytest.mark.parametrize("sentence", MORE_APL)
def test_more_of_the_second_notation(tables, sentence):
    check(apl, sentence, tables, "dense")


def refused(language, sentence, match, **values):
    with pytest.raises(Exception, match=match):
        language(sentence, values).to_df("v").collect()


def test_what_has_no_answer_is_refused(spark):
    df = spark.createDataFrame([(0, -1.0, 5), (1, 4.0, 0), (2, None, 2)], "p long, x double, k long")
    t, some = Table(df, pos="p"), Table(df.where("p < 2"), pos="p")
    for sentence in ("+/ {x}", "({x} > 0) # {x}", "(+/ % #) {x}", "+/\\ {x}"):
        refused(j, sentence, "column x holds nulls", x=t["x"])
    x, k = some["x"], some["k"]
    for sentence in ("2 ^. {x}", "{x} ^ 0.5", "3 %: {x}", "_1 o. 8 * {x}", "%: {x}", "0 o. 9 * {x}"):
        refused(j, sentence, "domain error", x=x)
    for sentence in ("{k} +: 1", "{k} *: 1"):
        refused(j, sentence, "logic of other numbers", k=k)
    refused(j, "{k} { {x}", "index error", k=k, x=x)
    refused(j, "{k} { 1 2 3", "index error", k=k)
    refused(j, "7 { {x}", "index error", x=x)
    refused(apl, "?{k}", "domain error", k=k)
    refused(apl, "{x}÷0", "division by zero", x=x)
    for gapped in ([5, 7, 9], [0, 1, 1], [1, 2, 3]):
        pos = spark.createDataFrame([(p, 1.0) for p in gapped], "p long, x double")
        refused(j, "|. {x}", "does not hold the positions", x=Table(pos, pos="p")["x"])
        assert j("+/ {x}", {"x": Table(pos, pos="p")["x"]}).tolist() == 3.0  # nothing counts on them
    for sentence in ("(<: ^: (>&3)) {k}", "({+/,⍵}⌺3) {x}"):
        with pytest.raises(NotYet):
            (apl if "⌺" in sentence else j)(sentence, {"x": x} if "⌺" in sentence else {"k": k})


def test_long_vectors_are_shown_by_their_ends(spark):
    t = Table(spark.range(5000).selectExpr("id as p", "id as x"), pos="p")
    shown = str(j("{x}", {"x": t["x"]})).split("\n")
    assert shown[0].startswith("0 1 2 ") and shown[1] == "(4000 more)" and shown[2].endswith(" 4998 4999")


def test_least_squares_keeps_its_digits(spark):
    rows = [(i, 1.0, 1e7 + i, 3.0 + 2.0 * (1e7 + i)) for i in range(40)]
    t = Table(spark.createDataFrame(rows, "p long, a double, b double, y double").repartition(5), pos="p")
    got = j("{y} %. {m}", {"y": t["y"], "m": t.matrix("a", "b")}).tolist()
    assert got[1] == pytest.approx(2.0, rel=1e-9) and got[0] == pytest.approx(3.0, abs=1e-2)


def test_empty_tables(spark):
    t = Table(spark.createDataFrame([], "p long, x double, k long"), pos="p")
    for sentence, want in (("+/ {x}", 0), ("<./ {x}", float("inf")), (">./ {x}", float("-inf")), ("*/ {x}", 1), ("# {x}", 0)):
        assert j(sentence, {"x": t["x"]}).tolist() == want
    for sentence in ("+/\\ {x}", "3 +/\\ {x}", "~. {x}", "/:~ {x}", "({x} > 0) # {x}", "{k} +//. {x}", "|. {x}", "([ + 0.5 * ])/\\. {x}"):
        assert j(sentence, {n: t[n] for n in "xk" if f"{{{n}}}" in sentence}).tolist() == []
    assert j("3 {. {x}", {"x": t["x"]}).tolist() == [0, 0, 0]


def test_streams(spark, tmp_path):
    from pleat.streaming import over_stream

    spark.range(10).selectExpr("cast(id as double) as x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").parquet(str(tmp_path / "in"))
    out = over_stream(j, "2 * ({x} > 4) # {x}", stream, {"x": "x"})
    query = out.writeStream.format("memory").queryName("doubled").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["v"] for r in spark.table("doubled").collect()) == [10.0, 12.0, 14.0, 16.0, 18.0]
    with pytest.raises(NotYet):
        over_stream(j, "+/\\ {x}", stream, {"x": "x"})


@pytest.mark.parametrize("sentence", ["12 o. r. {x}", "12 o. r. - 100 * {x}", "12 o. r. {k}", "12 o. r. {b}", "12 o. 2 + r. {x}", "12 o. r. 1 }. {x}"])
def test_angles_of_unit_numbers(tables, sentence):
    check(j, sentence, tables, "dense")


def test_angles_up_to_half_a_turn_keep_their_digits(spark):
    x = [0.00575, -0.07195, 0.02245, 3.1, float(np.pi), -float(np.pi)]
    t = Table(spark.createDataFrame(list(enumerate(x)), "p long, x double"), pos="p")
    assert [r.v for r in j("12 o. r. {x}", {"x": t["x"]}).to_df("v", pos="pos").orderBy("pos").collect()] == x


@pytest.mark.parametrize("sentence", ["(1.5&*) ^: 3 {x}", "(*&0.1) ^: 2 {x}", "(3&*) ^: 4 {k}", "(_2&*) ^: 3 {x}", "2 (* ^: 5) {x}", "(0&*) ^: 2 {x}", "(1e_200&*) ^: 2 {x}", "(1.5&*) ^: 1 {x}", "(1.5&*) ^: 0 {x}", "(1.5&+) ^: 3 {x}", "3 (2&*) {x}", "(2&*) ^: 3 {b}"])
def test_repeated_products(tables, sentence):
    check(j, sentence, tables, "dense")


def test_a_repeated_product_beyond_all_floats_is_taken_in_steps(spark):
    t = Table(spark.createDataFrame([(0, 1e-300)], "p long, x double"), pos="p")
    assert j("(1e200&*) ^: 2 {x}", {"x": t["x"]}).to_df("v").first().v == pytest.approx(1e100)
