"""Answers of the two notations on local arrays: properties of the languages."""

import numpy as np
import pytest

from pleat import apl, apl_modern, apl_with, j
from pleat.errors import DomainError, IndexRefused, LanguageError, LengthError, LimitError, NotYet, ParseError, Sandboxed, ValueUnknown
from pleat.frontend.dialect import Dialect

J = [
    ("+/ 0 $ 5", "0"), ("<./ 0 $ 5", "_"), ("-/\\ 9 4 1 6", "9 5 6 0"), ("%/\\ 8 4 2", "8 2 4"), ("+/\\. 4 7 1", "12 8 1"), ("-/\\. 9 4 1", "6 3 1"), ("([ + 0.25 * ])/\\. 8 4 4", "9.25 5 4"),
    ("_4 | 6 7 8 9", "_2 _1 0 _3"), ("(i. 2 2) + 5 50", "5 6\n52 53"), ("0 % 0", "0"), ("+//. i. 2 3", "0 4 6 5"), ("7 8 7 +//. 1 2 4", "5 2"), ("/: 5 2 9 2", "1 3 0 2"), ("5 {. 7 8", "7 8 0 0 0"),
    ("_1 {. 4 6", "6"), ("_ * 0", "0"), ("2 = 2 + 2^_40", "0"), ("%: _9", "0j3"), ("x: 0.25", "1r4"), ("3x % 12", "1r4"), ("! 22x", "1124000727777607680000"), ("8 9 , i. 2 3", "8 9 0\n0 1 2\n3 4 5"), ("$ 2 $ i. 5 2", "2 2"),
    ("3 3 #: 7", "2 1"), ("< 'xy'", "+--+\n|xy|\n+--+"), ("2 +/\\ 5 1 7", "6 8"), ("_3 +/\\ 1 1 1 5", "3 5"), ("1 +/\\. 2 3 4", "7 6 5"), ("(>./ - <./) 3 2 $ 5 1 2 8 0 4", "5 7"), ("(i. 2 2) +/ . * 2 2 $ 1 0 2 1", "2 1\n8 3"),
    ("I. 1 0 3", "0 2 2 2"), ("10 20 I. 5 10 15 25", "0 0 1 2"), ("~. 'banana'", "ban"), ("0 1 1 # 'abc'", "bc"), ("'xyz' i. 'zax'", "2 3 0"), ("p: 5 10", "13 31"), ("q: 84", "2 2 3 7"), ("A. 1 2 0", "3"), ("5 A. 'pqr'", "rqp"),
    ("p. 8 _6 1", "+-+---+\n|1|4 2|\n+-+---+"), ("1 0 3 p. 2", "13"), ("23 b. / 12 10", "14"), ("# &.> 'cd';'efg'", "+-+-+\n|2|3|\n+-+-+"), ("-:^:2 ] 12", "3"), ("(*:^:_1) 49", "7"), ("0 (2)} 5 6 7", "5 6 0"), ("1 0 0 1 <;.1 'wxyz'", "+---+-+\n|wxy|z|\n+---+-+"),
    ("spread =. >./ - <./\nspread 4 9 2", "7"), ("f =. 3 : 'if. y > 5 do. y - 5 else. y + 5 end.'\nf 9", "4"), ("g =. {{ y - x * 2 }}\n3 g 10", "4"), ("halves =. 3 : 'if. y < 2 do. 0 else. 1 + halves <. y % 2 end.'\nhalves 40", "5"), ("again =. 1 : 'u u u y'\n*: again 2", "256"),
    ("-/ . * 2 2 $ 5 1 2 3", "13"), ("%. 2 2 $ 4 0 0 5", "0.25   0\n   0 0.2"), (";: 'b =: 7 8'", "+-+--+---+\n|b|=:|7 8|\n+-+--+---+"), ("7j2 \": 2.71828", "   2.72"),
    ("3!:0 (3)", "4"), ("|: i. 3 2", "0 2 4\n1 3 5"), ("_1 |. 4 5 6", "6 4 5"), ("|.!.9 (4 5 6)", "9 4 5"), ("(<0 1) { i. 2 2", "1"), ("\". '6 * 7'", "42"), ("4 q: 90", "1 2 1 0"),
]
APL = [
    ("+/2 2⍴4 1 3 5", "5 8"), ("+⌿2 2⍴4 1 3 5", "7 6"), ("3+/2 4 6 8", "12 18"), ("¯2-/5 3 9", "¯2 6"), ("¯5|7 12 15", "¯3 ¯3 0"), ("0÷0", "1"), ("⍋9 2 7", "2 3 1"), ("2 3∘.+10 20", "12 22\n13 23"), ("⍸0 1 1", "2 3"), ("⌈/3 9 4", "9"),
    ("≡(8 9)(7 6)", "2"), ("⊂7", "7"), ("0 1 1/4 5 6", "5 6"), ("3⊥1 2", "5"), ("4 5 6∩6 4", "4 6"), ("↑9 8", "9"), ("2 2 2⊤6", "1 1 0"), ("×\\2 3 4", "2 6 24"), ("(⌈/-⌊/)8 3 5", "5"), ("{⍵+10}¨5 6", "15 16"), ("8{⍺-⍵}3", "5"),
    ("B←4 5 6 ⋄ B[1]←0 ⋄ B", "0 5 6"), ("(2 2⍴⍳4)[1;]", "1 2"), ("5 6⍳6 7", "2 3"), ("{⍵<3:⍵ ⋄ (∇⍵-1)+∇⍵-2}7", "21"), ("+.×⍨2 2⍴1 0 2 1", "1 0\n4 1"), ("3*⍨2", "8"), ("⌽'abc'", "cba"), ("1 2 2⊂'xyz'", "x  yz"), ("g←{⍺⍺ ⍵×2} ⋄ -g 4", "¯8"),
    ("∇Z←PROD N;I\nZ←1\nI←0\nL:I←I+1\nZ←Z×I\n→(I<N)/L\n∇\nPROD 4", "24"), ("∇Z←ODD N\n:If 1=2|N\nZ←1\n:Else\nZ←0\n:EndIf\n∇\nODD 7", "1"), ("×¯8 5", "¯1 1"), ("∪7 7 2", "7 2"), ("4 2∪2 9", "4 2 9"), ("¯1↑5 6", "6"), ("'xyz'⍳'z'", "3"),
]


def same(got: str, want: str) -> bool:
    return [x.split() for x in got.rstrip().split("\n")] == [x.split() for x in want.rstrip().split("\n")]


@pytest.mark.parametrize(("sentence", "answer"), J)
def test_j(sentence, answer):
    assert same(str(j(sentence)), answer)


@pytest.mark.parametrize(("sentence", "answer"), APL)
def test_apl(sentence, answer):
    assert same(str(apl(sentence)), answer)


@pytest.mark.parametrize(("language", "sentence", "error"), [
    (j, "1 2 + 1 2 3", LengthError), (j, "5 { 1 2", IndexRefused), (j, "foo 1", ValueUnknown), (j, "+: 'a'", DomainError), (j, "_ - _", LanguageError), (j, "1 +", ParseError), (j, "1!:1 <'f'", LanguageError), (j, "6!:0 ''", Sandboxed), (j, "13 : 'y'", NotYet),
    (j, "f =. 3 : 'f y'\nf 1", LimitError), (apl, "1÷0", DomainError), (apl, "1 2+1 2 3", LengthError), (apl, "⎕TS", Sandboxed), (apl, "x+1", ValueUnknown), (apl, "(1", ParseError), (apl, "'a'+1", DomainError),
])
def test_refusals(language, sentence, error):
    with pytest.raises(error):
        language(sentence)


def test_errors_point_at_the_place():
    with pytest.raises(LengthError) as e:
        j("1 + 1 2 + 1 2 3")
    assert "^" in str(e.value)


def test_holes_and_kernels():
    k = j.compile("+/ {w} * {x}")
    assert k.names == ("w", "x")
    half = k.bind({"w": [1, 2, 3]})
    assert half({"x": [1, 1, 2]}).tolist() == 9
    with pytest.raises(ValueUnknown):
        half()
    with pytest.raises(ValueUnknown):
        k.bind({"q": 1})
    assert "words:" in half.explain({"x": [1, 1, 2]})
    assert half.deploy("gpu")({"x": [0, 0, 1]}).tolist() == 3


def test_boundary_values():
    import pyarrow as pa

    assert j("+/ {a}", {"a": np.arange(6, dtype=np.int32).reshape(2, 3)}).tolist() == [3, 5, 7]
    assert j("+/\"1 {a}", {"a": pa.table({"x": [1, 2], "y": [10, 20]})}).tolist() == [11, 22]
    with pytest.raises(DomainError, match="y"):
        j("{a}", {"a": pa.table({"y": [1, None]})})
    with pytest.raises(DomainError):
        j("{a}", {"a": pa.table({"x": [1], "y": [1.5]})})
    assert j("{a}", {"a": [[1, 2], [3]]}).tolist() == [[1, 2], [3]]
    assert pa.table(j("1 2 3")).column(0).to_pylist() == [1, 2, 3]


def test_dialects():
    assert same(str(apl_with(Dialect(origin=0))("⍳3")), "0 1 2")
    assert same(str(apl_modern("↑(1 2)(3 4)")), "1 2\n3 4")
    assert same(str(apl_modern("⊃(1 2)(3 4)")), "1 2")


def test_output_and_input():
    seen = []
    j.compile("echo 1 2\n3")(out=seen.append)
    assert "".join(seen) == "1 2\n"
    assert str(j.compile("1!:1 ]1")(read=lambda: "typed")) == "typed"
    apl.compile("⎕←1 2")(out=seen.append)
    assert "".join(seen) == "1 2\n1 2\n"


def test_command_line(capsys, tmp_path):
    from pleat.__main__ import main

    assert main(["eval", "+/ 4 5 6"]) == 0
    assert capsys.readouterr().out.strip() == "15"
    assert main(["eval", "--notation", "apl", "⌈/4 9"]) == 0
    assert capsys.readouterr().out.strip() == "9"
    f = tmp_path / "a.apl"
    f.write_text("x←⍳5\n×/x")
    assert main(["run", str(f)]) == 0
    assert capsys.readouterr().out.strip() == "120"
    assert main(["plan", "+/ 4 5"]) == 0
    assert "words: + / 4 5" in capsys.readouterr().out
    assert main(["eval", "1 +"]) == 1
    assert "^" in capsys.readouterr().err
    other = tmp_path / "a.txt"
    other.write_text("1")
    assert main(["run", str(other)]) == 2 and "notation" in capsys.readouterr().err
    assert main(["run", "--notation", "j", str(other)]) == 0
    assert main(["run", str(tmp_path / "none.j")]) == 2
