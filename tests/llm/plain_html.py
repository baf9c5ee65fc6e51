"""A plain twin of site template removal: trees of nodes, subtrees written out instead of hashed, counts in dicts."""

import html
import re
from collections import defaultdict

from vellumspark.llm.html_templates import _BLANKS, _BLOCK, _CLOSES, _KEPT, _RAW, _SILENT, _TOKEN, _VOID

_INLINE_BREAK = frozenset(("br", "hr"))


class Node:
    """An element: parts are its attributes' key, texts and child nodes in order."""

    __slots__ = ("parts", "same", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.parts, self.same = tag, [attributes], ()

    def close(self) -> None:
        """All children are closed: what the subtree is, written out."""
        self.same = (self.tag, *(part.same if isinstance(part, Node) else _BLANKS.sub(" ", part) for part in self.parts))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in the order in which they close."""
    root = Node("#root", "")
    stack, closed = [root], []
    at = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.close()
            closed.append(node)

    while match := _TOKEN.search(page, at):
        if match.start() > at:
            stack[-1].parts.append(page[at : match.start()])
        at = match.end()
        end, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            if match[0].startswith("<![CDATA["):
                stack[-1].parts.append(match[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if end:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag in _CLOSES:
            own, walls = _CLOSES[tag]
            depth = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in walls:
                    break
                if stack[k].tag in own:
                    depth = k
            if depth is not None:
                close_to(depth)
        node = Node(tag, attributes.rstrip("/").strip())
        stack[-1].parts.append(node)
        if tag in _VOID or (attributes.endswith("/") and tag not in _RAW):
            node.close()
            closed.append(node)
            continue
        stack.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            node.parts.append(page[at : stop.start() if stop else len(page)])
            at = stop.start() if stop else len(page)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    close_to(1)
    return root, closed


def _running(root: Node, gone: set[int]) -> set[int]:
    """Inline elements of gone that lie in running text: in a block that stays and has words outside of gone elements."""
    words: set[int] = set()
    inline: list[tuple[int, int]] = []
    todo = [(root, id(root), True)]
    while todo:
        item, block, kept = todo.pop()
        for part in item.parts[1:]:
            if isinstance(part, str):
                if kept and block not in words and any(c.isalnum() for c in html.unescape(part)):
                    words.add(block)
            elif part.tag in _BLOCK:
                if id(part) not in gone:
                    todo.append((part, id(part), True))
            elif part.tag not in _SILENT:
                if id(part) in gone:
                    inline.append((id(part), block))
                todo.append((part, block, kept and id(part) not in gone))
    return {node for node, block in inline if block in words}


def text_of(root: Node, gone: set[int]) -> tuple[str, int]:
    """Text of what isn't deleted, and the number of deleted subtrees. gone: ids of nodes to delete."""
    out: list[str] = []
    removed = 0
    gone = gone - _running(root, gone) if gone else gone
    todo: list[Node | str] = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if id(item) in gone:
            removed += 1
            out.append("\n" if item.tag in _BLOCK else " ")
            continue
        if item.tag in _SILENT:
            continue
        edge = "\n" if item.tag in _BLOCK or item.tag in _INLINE_BREAK else ""
        todo.append(edge)
        for part in reversed(item.parts[1:]):
            todo.append(part if isinstance(part, Node) else _BLANKS.sub(" ", html.unescape(part)))
        todo.append(edge)
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


def slow_extract(rows, min_pages, min_share):
    """rows: (page_id, url, html). (page_id, host, text, n_removed) of each, as strings."""

    def host(url):
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        return found[1].lower() if found else ""

    name = defaultdict(list)  # urls of a payload: any one of them names the page
    for _, url, text in rows:
        if host(url):
            name[host(url), text].append(url)
    # the name is the url of least hash in Spark; which one doesn't matter unless a url has several payloads as well
    canon = {k: min(v) for k, v in name.items()}
    seen, pages = defaultdict(set), defaultdict(set)
    for (h, text), page in canon.items():
        pages[h].add(page)
        for node in parse(text or "")[1]:
            if node.tag not in _KEPT and node.tag not in _VOID:
                seen[h, node.same].add(page)
    out = []
    for i, url, text in rows:
        h = host(url)
        root, closed = parse(text or "")
        gone = {id(n) for n in closed if h and n.tag not in _KEPT and n.tag not in _VOID and len(seen[h, n.same]) >= max(min_pages, len(pages[h]) * min_share)}
        out.append((str(i), h, *text_of(root, gone)))
    return sorted(out)
