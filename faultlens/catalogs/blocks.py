"""How blocks of each language are headed, and what is looked for inside them.

The words are fixed values. A *kind* is what a block is: ``faultlens.functions.blocks``
keeps the kinds of all open blocks while it reads a file's braces (Ruby: ``end``), so
rules can ask for one thing inside another, at any depth.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds of blocks. ``caught_loop`` is a catch block somewhere inside a loop.
KINDS = ("loop", "try", "catch", "retry_method", "literal", "caught_loop")
#: What may stand inside a block, besides a block.
EVENTS = ("status", "wait", "again", "recover", "bare_loop")

#: Balanced parentheses, three deep.
PARENS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
#: Headings that stand between another one and the brace of both.
_BETWEEN = (rf"(?:(?:if|while|for|foreach|switch|using|lock|synchronized|catch|try)\b\s*+(?:{PARENS})?\s*+"
            r"|(?:else|do)\b\s*+)")
#: A heading counts where a brace follows, at once or after further headings.
BRACE = rf"(?=\s*+{_BETWEEN}{{0,8}}+\{{)"
_WORD = r"(?<![\w$.])"


@dataclass(frozen=True)
class Blocks:
    """``headings`` and ``events``: (kind, pattern, how the text it finds begins).
    ``needs``: some word of each group must occur in a file for any pair to be found."""

    headings: tuple[tuple[str, str, str], ...]
    events: tuple[tuple[str, str, str], ...]
    needs: tuple[tuple[tuple[str, ...], ...], ...]
    #: Blocks that end with a word: what opens one of no particular kind, and that word.
    opens: str = ""
    ends: str = ""


def _head(kind: str, words: str, parens: str = rf"\s*+{PARENS}") -> tuple[str, str, str]:
    return kind, rf"{_WORD}(?:{words})\b{parens}{BRACE}", rf"^(?:{words})\b"


def _event(kind: str, words: str, after: str = r"\s*+\(", before: str = r"(?<![\w$])") -> tuple[str, str, str]:
    return kind, rf"{before}(?:{words}){after}", rf"^(?:{words})"


_AGAIN = _event("again", "continue", r"\b")
_STATUS = _event("status", r"(?i:status_?code)", "", "")

BLOCKS: dict[str, Blocks] = {
    "java": Blocks(
        (_head("loop", "for|while"), _head("loop", "do", ""), _head("try", "try", rf"(?:\s*+{PARENS})?"),
         _head("catch", "catch")),
        (_STATUS, _event("wait", "sleep|parkNanos"), _AGAIN),
        needs=((("catch",), ("tatus", "TATUS")),
               (("catch",), ("for", "while", "do"), ("sleep", "parkNanos", "continue"))),
    ),
    "javascript": Blocks(
        (_head("loop", "for|while", rf"\s*+(?:await\s*+)?{PARENS}"), _head("loop", "do", ""),
         _head("try", "try", ""), _head("catch", "catch", rf"(?:\s*+{PARENS})?")),
        (_event("wait", "sleep|delay|wait|setTimeout"), _AGAIN),
        needs=((("catch",), ("for", "while", "do"), ("sleep", "delay", "wait", "setTimeout", "continue")),),
    ),
    "go": Blocks(
        # Each stops at the next word of its own, so a line is read once.
        (("loop", rf"{_WORD}for\b(?:[^{{}}\nf]++|f(?!or\b))*+(?=\{{)", r"^for\b"),
         ("catch", rf"{_WORD}if\b(?:[^{{}}\nie]++|i(?!f\b)|e(?:(?<=\we)|(?!rr\s*+!=)))*+"
                   r"err\s*+!=\s*+nil\b(?:[^{}\ni]++|i(?!f\b))*+(?=\{)", r"^if\b"),
         ("literal", rf"{_WORD}func\s*+{PARENS}(?:[^{{}}\nf]++|f(?!unc\b))*+(?=\{{)", r"^func\b")),
        (_event("recover", "recover"), _event("wait", r"time\s*+\.\s*+(?:Sleep|After)"), _AGAIN),
        needs=((("recover",), ("func",)), (("err",), ("for",), ("Sleep", "After", "continue"))),
    ),
    "ruby": Blocks(
        (("loop", r"(?<![\w.:@$])(?:while|until|for)\b[^\n;]*?(?:\bdo\b|(?=[\n;]|\z))|(?<![\w:@$])(?:loop|times|each\w*+|upto|step)"
                  rf"\b(?:\s*+{PARENS})?\s*+(?:do\b|\{{)",
          r"^(?:while|until|for|loop|times|each|upto|step)"),
         ("try", r"(?<![\w.:@$])begin\b", r"^begin\b")),
        (_event("wait", "sleep", r"\b", r"(?<![\w.:@$])"), _event("again", "retry|next", r"\b", r"(?<![\w.:@$])")),
        needs=((("rescue",), ("sleep", "retry", "next")),),
        opens=r"(?m:^[ \t]*+(?:[\w.@]++\s*+=\s*+)?)(?:def|class|module|if|unless|case)\b|(?<![\w.:@$])do\b",
        ends=r"(?<![\w.:@$])end\b(?![?!:])",
    ),
    "csharp": Blocks(
        (_head("loop", "for|foreach|while"), _head("loop", "do", ""), _head("try", "try", ""),
         _head("catch", "catch", rf"(?:\s*+{PARENS})?(?:\s*+when\s*+{PARENS})?"),
         ("retry_method",
          rf"(?<=[\w>\]?])\s++\w*+(?<=(?i:retry|retries)\w{{0,40}})\s*+(?:<[^<>()]*+>\s*+)?{PARENS}"
          r"(?:\s*+where\b(?:[^{;(w]++|w(?!here\b)|\(\))*+)*+(?=\s*+\{)", r"^\s")),
        (_event("wait", r"Delay|Sleep", r"\s*+\(", r"(?<=\.)"), _AGAIN,
         # A loop without a brace; tried after the headings.
         ("bare_loop", rf"{_WORD}(?:for|foreach|while)\b(?=\s*+\()", r"^(?:for|foreach|while)$")),
        needs=((("etry", "etries", "ETRY"), ("for", "while")),
               (("catch",), ("for", "while", "do"), ("Delay", "Sleep", "continue"))),
    ),
}
BLOCKS["typescript"] = BLOCKS["javascript"]
