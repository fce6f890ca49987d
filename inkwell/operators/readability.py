"""The article of a page that doesn't mark it: paragraphs score, and their scores go up the tree.

A paragraph is worth more the longer it is and the more commas it has. Its
parent gets that in full, the one above half, others less. What is mostly links
counts little. The best element is the article, with those beside it that look
like parts of it.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .html import Node

#: Letters that a paragraph needs, elements whose scores begin higher or lower, and names that speak for or against one.
_LEAST = 25
_BEGIN = {"div": 5, "article": 10, "main": 10, "section": 5, "blockquote": 3, "pre": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "form": -3, "address": -3}
_FOR = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
_AGAINST = re.compile(r"comment|foot|header|menu|meta|nav|promo|related|share|sidebar|sponsor|widget", re.I)
_PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote"))
#: Levels that a paragraph's score goes up, and the share of the best score that makes a neighbour part of the article.
_LEVELS, _SHARE = 4, 0.2


class _Measure:
    """Lengths of texts, and of the texts of links, of every element, in one walk."""

    def __init__(self, root: Node) -> None:
        self.length: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        todo: list[tuple[Node, bool]] = [(root, False)]
        while todo:
            node, done = todo.pop()
            inner = [c for c in node.children if not isinstance(c, str)]
            if not done:
                todo.append((node, True))
                todo += [(c, False) for c in inner]
                continue
            own = sum(len(re.sub(r"\s+", " ", c).strip()) for c in node.children if isinstance(c, str))
            self.length[id(node)] = own + sum(self.length[id(c)] for c in inner)
            self.linked[id(node)] = self.length[id(node)] if node.tag == "a" else sum(self.linked[id(c)] for c in inner)

    def density(self, node: Node) -> float:
        """The share of an element's text that is links."""
        n = self.length[id(node)]
        return self.linked[id(node)] / n if n else 0.0


def _begin(node: Node) -> float:
    name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return _BEGIN.get(node.tag, 0) + 25 * bool(_FOR.search(name)) - 25 * bool(_AGAINST.search(name))


def article(root: Node) -> list[Node]:
    """The elements of the article, in order; none if no paragraph is long enough."""
    measure, scores, nodes = _Measure(root), {}, {}
    for node in root.walk():
        loose = node.tag in ("div", "section") and any(isinstance(c, str) and len(c.strip()) >= _LEAST for c in node.children)
        if not (node.tag in _PARAGRAPHS or loose) or measure.length[id(node)] < _LEAST:
            continue
        worth = 1 + len(re.findall(r"[,،、，]", node.text())) + min(measure.length[id(node)] // 100, 3)
        up = node if loose else node.parent
        for level in range(_LEVELS):
            if up is None or up.tag in ("html", "#document"):
                break
            if id(up) not in scores:
                scores[id(up)], nodes[id(up)] = _begin(up), up
            scores[id(up)] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = up.parent
    final = {k: s * (1 - measure.density(nodes[k])) for k, s in scores.items()}
    if not final:
        return []
    best = nodes[max(final, key=lambda k: final[k])]
    if best.parent is None or best.tag == "body":
        # paragraphs right below the page: what is beside them is not joined, but weeded
        return [c for c in best.children if not isinstance(c, str) and _part(c, measure, final, 0.0)] or [best]
    least = max(10.0, final[id(best)] * _SHARE)
    return [c for c in best.parent.children if not isinstance(c, str) and (c is best or _part(c, measure, final, least))]


def _part(node: Node, measure: _Measure, final: dict[int, float], least: float) -> bool:
    """Whether an element beside the best one belongs to the article."""
    if least and final.get(id(node), 0.0) >= least:
        return True
    n, density = measure.length[id(node)], measure.density(node)
    if node.tag in ("nav", "aside", "footer", "header", "form", "ul", "ol") and density > 0.5:
        return False
    if not least and (node.tag[0] == "h" and node.tag[1:].isdigit() or final.get(id(node), 0.0) > 0):
        return True
    return node.tag == "p" and ((n > 80 and density < 0.25) or (0 < n <= 80 and density == 0 and bool(re.search(r"[.!?。]\s*$", node.text()))))


def fits(whole: int, read: int) -> bool:
    """As :func:`.gates.readability_fits`, for the words of one page and of its article."""
    return read > 0 and not (whole >= 600 and read / whole < 0.35) and not (whole >= 300 and read < 120)
