"""What a page's style sheets hide: selectors matched with specificity, rules cascaded."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .html import Node

_WATCHED = ("display", "visibility", "opacity")
_COMPOUND = re.compile(r"""(?:[a-z][\w-]*|\*)?(?:[.#][\w-]+|\[[^\]]*\]|:not\([^)]*\))*""", re.I)
_STEP = re.compile(r"\s*([>+~])\s*|\s+")
#: Media that a reader sees.
_MEDIA = re.compile(r"@media\s+(?:all|screen|only\s+screen)\s*$", re.I)


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """The watched properties of a block: (value, whether it is important); a later one wins, unless an earlier is important."""
    found: dict[str, tuple[str, bool]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in _WATCHED:
            important = value.endswith("!important")
            if important or not found.get(name, ("", False))[1]:
                found[name] = (value.removesuffix("!important").strip(), important)
    return found


def _blocks(css: str) -> list[tuple[str, str]]:
    """(selector list, declarations) of plain rules and of those in media that a reader sees."""
    css, out, at = re.sub(r"(?s)/\*.*?\*/", " ", css), [], 0
    while (brace := css.find("{", at)) >= 0:
        head, depth, end = css[at:brace].rpartition(";")[2].strip(), 1, brace + 1
        while end < len(css) and depth:
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        body, at = css[brace + 1 : end - (depth == 0)], end
        if not head.startswith("@"):
            out.append((head, body))
        elif _MEDIA.match(head):
            out += _blocks(body)
    return out


def _steps(selector: str) -> list[tuple[str, str]] | None:
    """A selector as (combinator before it, compound), or None if it has parts that are not known here."""
    steps, at, joint = [], 0, ""
    selector = selector.strip()
    while at < len(selector):
        m = _COMPOUND.match(selector, at)
        if not m or not m[0]:
            return None
        steps.append((joint, m[0]))
        at = m.end()
        if at < len(selector):
            gap = _STEP.match(selector, at)
            if not gap or gap.end() == len(selector):
                return None
            joint, at = gap[1] or " ", gap.end()
    return steps or None


def specificity(steps: list[tuple[str, str]]) -> tuple[int, int, int]:
    """(ids, classes and attributes, elements); what ``:not`` holds counts, itself it doesn't."""
    text = " ".join(re.sub(r":not\(([^)]*)\)", r" \1", s) for _, s in steps)
    bare = re.sub(r"\[[^\]]*\]", "[", text)
    return bare.count("#"), bare.count(".") + bare.count("["), len(re.findall(r"(?:^|\s)[a-z]", bare, re.I))


def matches(steps: list[tuple[str, str]], node: Node, one) -> bool:
    """Whether the steps select a node; ``one`` tells it for a compound. A child's or descendant's steps are tried from every place they may be at."""
    joint, compound = steps[-1]
    if not one(compound, node):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if joint in "+~":
        around = [c for c in node.parent.children if not isinstance(c, str)] if node.parent is not None else []
        place = next((i for i, c in enumerate(around) if c is node), 0)
        before = around[max(0, place - 1) : place] if joint == "+" else around[:place]
        return any(matches(rest, b, one) for b in before)
    up = node.parent
    while up is not None:
        if matches(rest, up, one):
            return True
        up = up.parent if joint == " " else None
    return False


class Sheet:
    """A page's rules on what is shown."""

    def __init__(self, css: str, one) -> None:
        self.one, self.rules = one, []
        for order, (heads, body) in enumerate(_blocks(css)):
            found = declarations(body)
            for head in heads.split(",") if found else ():
                steps = _steps(head)
                if steps:
                    self.rules.append((specificity(steps), order, steps, found))
        self.rules.sort(key=lambda r: r[:2])

    def shown(self, node: Node) -> dict[str, str]:
        """The watched properties that hold for a node: by importance, then inline before rules, specificity, order."""
        won: dict[str, tuple[tuple, str]] = {}
        inline = declarations(node.attrs.get("style", ""))
        for rank, found in [((0, *r[:2]), r[3]) for r in self.rules if matches(r[2], node, self.one)] + [((1,), inline)]:
            for name, (value, important) in found.items():
                key = (important, *rank)
                if name not in won or key >= won[name][0]:
                    won[name] = (key, value)
        return {name: value for name, (_, value) in won.items()}

    def hides(self, node: Node) -> bool:
        held = self.shown(node)
        return held.get("display") == "none" or held.get("visibility") == "hidden" or bool(re.fullmatch(r"0*\.?0+%?", held.get("opacity", "1")))
