"""A compact trie of directories: the deepest value on the way to a path."""

from __future__ import annotations


class RadixTrie:
    """Edges hold runs of segments, so a chain of directories without values of their own is one step."""

    __slots__ = ("value", "edges")

    def __init__(self):
        self.value: str | None = None
        self.edges: dict[str, tuple[tuple[str, ...], RadixTrie]] = {}

    def put(self, segments: tuple[str, ...], value: str) -> None:
        node = self
        while segments:
            run, child = node.edges.get(segments[0], (segments, None))
            if child is None:
                child = RadixTrie()
                node.edges[segments[0]] = (segments, child)
                node, segments = child, ()
                continue
            same = next((i for i, (a, b) in enumerate(zip(run, segments, strict=False)) if a != b), min(len(run), len(segments)))
            if same < len(run):
                between = RadixTrie()
                between.edges[run[same]] = (run[same:], child)
                node.edges[segments[0]] = (run[:same], between)
                child = between
            node, segments = child, segments[same:]
        node.value = value

    def deepest(self, segments: tuple[str, ...]) -> str | None:
        """The value of the longest prefix of ``segments`` that has one."""
        node, best, at = self, self.value, 0
        while at < len(segments):
            found = node.edges.get(segments[at])
            if found is None or segments[at:at + len(found[0])] != found[0]:
                break
            at += len(found[0])
            node = found[1]
            best = node.value if node.value is not None else best
        return best
