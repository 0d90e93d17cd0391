"""Control structures and branches of defined functions."""

from __future__ import annotations

import re

import numpy as np

from ..errors import LimitError, NotYet, ParseError
from ..operators import derived as d

MOST_STEPS = 1 << 22
WORD = re.compile(r"\s*:(If|ElseIf|Else|EndIf|End|While|EndWhile|Repeat|EndRepeat|Until|For|EndFor|Select|EndSelect|CaseList|Case|Return|Leave|Continue|AndIf|OrIf)\b(.*)$", re.I | re.S)


def structure(code: list[str]) -> list[tuple]:
    """Every line as (keyword or None, text, index)."""
    out = []
    for k, row in enumerate(code):
        for piece in row.split("⋄") if ":" in row and WORD.match(row) else [row]:
            m = WORD.match(piece)
            out.append((m[1].lower(), m[2], k) if m else (None, piece, k))
    return out


class Leave(Exception):
    pass


class Next(Exception):
    pass


def run_plan(machine, plan: list[tuple], code: list[str]) -> None:
    from .apl import Jump, Signal

    steps = 0

    def block(i: int, ends: tuple[str, ...]) -> int:
        """Index of the line among ``ends`` that closes the block beginning at i."""
        deep = 0
        while i < len(plan):
            w = plan[i][0]
            if deep == 0 and w in ends:
                return i
            if w in ("if", "while", "repeat", "for", "select"):
                deep += 1
            elif w in ("endif", "endwhile", "endrepeat", "until", "endfor", "endselect", "end"):
                deep -= 1
            i += 1
        raise ParseError(f"{' or '.join(ends)} is missing")

    def test(text_: str) -> bool:
        return d.truth(machine.execute(text_))

    def run(i: int, stop: int) -> None:
        nonlocal steps
        while i < stop:
            steps += 1
            if steps > MOST_STEPS:
                raise LimitError("the program does not end")
            w, text_, _ = plan[i]
            if w is None:
                if text_.strip():
                    machine.run_line(text_)
                i += 1
            elif w == "if":
                end = block(i + 1, ("endif", "end"))
                arms, k = [], i
                while k < end:
                    nxt = block(k + 1, ("elseif", "else", "endif", "end"))
                    arms.append((k, nxt))
                    k = nxt
                for k, nxt in arms:
                    if plan[k][0] == "else" or test(plan[k][1]):
                        run(k + 1, nxt)
                        break
                i = end + 1
            elif w == "while":
                end = block(i + 1, ("endwhile", "end", "until"))
                try:
                    while test(text_):
                        steps += 1
                        if steps > MOST_STEPS:
                            raise LimitError("the loop does not end")
                        try:
                            run(i + 1, end)
                        except Next:
                            pass
                except Leave:
                    pass
                i = end + 1
            elif w == "repeat":
                end = block(i + 1, ("until", "endrepeat", "end"))
                try:
                    while True:
                        steps += 1
                        if steps > MOST_STEPS:
                            raise LimitError("the loop does not end")
                        try:
                            run(i + 1, end)
                        except Next:
                            pass
                        if plan[end][0] == "until" and test(plan[end][1]):
                            break
                except Leave:
                    pass
                i = end + 1
            elif w == "for":
                end = block(i + 1, ("endfor", "end"))
                m = re.match(r"\s*([A-Za-z∆⍙_]\w*)\s*:In\b(.*)$", text_, re.I | re.S)
                if not m:
                    raise ParseError("a loop names its variable and its values")
                over = machine.execute(m[2])
                from ..operators.apl_verbs import elements

                try:
                    for v in elements(np.asarray(over)):
                        machine.put(m[1], v)
                        try:
                            run(i + 1, end)
                        except Next:
                            pass
                except Leave:
                    pass
                i = end + 1
            elif w == "select":
                end = block(i + 1, ("endselect", "end"))
                v = machine.execute(text_)
                from ..functions.scalar import match

                k, done = i, False
                k = block(i + 1, ("case", "caselist", "else", "endselect", "end"))
                while k < end and not done:
                    nxt = block(k + 1, ("case", "caselist", "else", "endselect", "end"))
                    if plan[k][0] == "else":
                        hit = True
                    else:
                        c = machine.execute(plan[k][1])
                        from ..operators.apl_verbs import elements

                        hit = any(match(v, e) for e in elements(c)) if plan[k][0] == "caselist" else match(v, c)
                    if hit:
                        run(k + 1, nxt)
                        done = True
                    k = nxt
                i = end + 1
            elif w == "return":
                raise Signal(None)
            elif w == "leave":
                raise Leave
            elif w == "continue":
                raise Next
            else:
                raise NotYet(f":{w}")

    at = 0
    while True:
        try:
            run(at, len(plan))
            return
        except Jump as j:
            steps += 1
            if steps > MOST_STEPS:
                raise LimitError("the program does not end") from None
            if not 1 <= j.line <= len(code):
                return
            at = next(i for i, p in enumerate(plan) if p[2] >= j.line - 1)
