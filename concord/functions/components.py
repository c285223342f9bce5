"""Component trees of generated files: closed nodes of cmp, props and children, and the rows they stand for."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

#: Component, the prop that a bare string sets, admitted props, admitted children.
COMPONENTS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...] | None]] = {
    "Project": ("folder", ("name", "folder"), ("Project", "Folder", "File", "CopyFiles")),
    "Folder": ("name", ("name",), ("Folder", "File", "CopyFiles")),
    "File": ("name", ("name", "exclude", "mode"), ("Content", "Line", "Fragment", "Inject", "ListItems", "CopyFiles")),
    "Content": ("src", ("arg", "src", "name", "indent", "extra", "replace", "raw"), None),
    "Line": ("src", ("arg", "src", "name", "indent", "extra", "replace", "raw"), None),
    "Fragment": ("from", ("from", "indent", "replace", "eject"), ("Slot", "Content", "Line", "ListItems")),
    "Slot": ("name", ("name",), ("Content", "Line", "Fragment", "ListItems")),
    "Inject": ("name", ("name", "markers", "exclude"), ("Content", "Line", "ListItems")),
    "CopyFiles": ("from", ("from", "to", "exclude", "replace"), None),
    "ListItems": ("item", ("item", "line", "indent"), ("Content", "Line", "Fragment")),
}

Node = dict[str, Any]


def _flat(children: Sequence[Any]) -> list[Any]:
    return [y for x in children for y in (_flat(x) if isinstance(x, list | tuple) else [x])]


def node(cmp: str, spec: str | dict[str, Any] | None = None, children: Sequence[Any] = ()) -> Node:
    """A node; unknown props, children that do not fit, and children of a leaf are refused."""
    short, props, admits = COMPONENTS[cmp]
    own = {} if spec is None else {short: spec} if isinstance(spec, str) else dict(spec)
    if bad := sorted(set(own) - set(props)):
        raise ValueError(f"func_arg: {cmp} has no {bad}")
    if admits is None and children:
        raise ValueError(f"func_arity: {cmp} takes no children")
    kids = []
    for c in _flat(children):
        if isinstance(c, str):
            if "Line" not in (admits or ()):
                raise ValueError(f"func_arg: {cmp} takes no text")
            c = node("Line", c)
        if c.get("cmp") not in (admits or ()):
            raise ValueError(f"func_arg: {cmp} takes no {c.get('cmp')}")
        kids.append(c)
    return {"cmp": cmp, "props": own, "children": kids}


def project(spec: str | dict | None = None, children: Sequence[Any] = ()) -> Node:
    return node("Project", spec, children)


def folder(spec: str | dict, children: Sequence[Any] = ()) -> Node:
    return node("Folder", spec, children)


def file(spec: str | dict, children: Sequence[Any] = ()) -> Node:
    return node("File", spec, children)


def content(spec: str | dict) -> Node:
    return node("Content", spec)


def line(spec: str | dict) -> Node:
    return node("Line", spec)


def fragment(spec: str | dict, children: Sequence[Any] = ()) -> Node:
    return node("Fragment", spec, children)


def slot(spec: str | dict, children: Sequence[Any] = ()) -> Node:
    return node("Slot", spec, children)


def inject(spec: str | dict, children: Sequence[Any] = ()) -> Node:
    return node("Inject", spec, children)


def copyfiles(spec: str | dict) -> Node:
    return node("CopyFiles", spec)


def listitems(spec: dict, children: Sequence[Any] = ()) -> Node:
    return node("ListItems", spec, children)


def rows(tree: Node, at: str = "") -> list[tuple[str, int, str]]:
    """(file, ordinal, text) of what a tree writes; a line ends its text, a content span does not."""
    name = tree["props"].get("folder") or tree["props"].get("name", "")
    if tree["cmp"] in ("Project", "Folder"):
        here = f"{at}/{name}" if at and name != "." else name or at
        return [r for c in tree["children"] for r in rows(c, here)]
    if tree["cmp"] != "File":
        return []
    path, out = f"{at}/{name}" if at else name, []

    def text(n: Node) -> None:
        if n["cmp"] in ("Line", "Content"):
            out.append(str(n["props"].get("indent", "")) + str(n["props"].get("src", "")) + "\n" * (n["cmp"] == "Line"))
        for c in n["children"]:
            text(c)

    text(tree)
    return [(path, i, t) for i, t in enumerate(out)]
