"""The walk of a file tree on the driver: which files are read, by name and size. Contents are read by tasks.

Listing is what Spark's own file index does on the driver too; here it prunes folders as it goes, and it sees dot
files, which Spark's listing leaves out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from keysift.sources.files import INTERESTING, ignore_rules

VERSION_CONTROL = frozenset((".git", ".hg", ".svn", ".bzr"))
IGNORE_FILE = ".gitignore"


def _python(pattern: str) -> str:
    return pattern.replace(r"\z", r"\Z")


@dataclass
class Ignore:
    """Patterns of ignore files, the later the stronger; a folder that is ignored hides all below it."""

    #: Pattern, whether it is for folders alone, whether it ignores.
    rules: list[tuple[re.Pattern, bool, bool]]

    @classmethod
    def of(cls, texts: Iterable[tuple[str, str]]) -> Ignore:
        return cls([(re.compile(_python(p)), not p.endswith(r"(?:/.*)?\z"), ignored) for p, ignored in ignore_rules(texts)])

    def hides(self, path: str, folder: bool) -> bool:
        """Whether the last pattern that fits the path itself ignores it; its parents are asked on their own."""
        return next((ignored for p, only, ignored in reversed(self.rules) if p.match(path + "/" if only and folder else path)), False)


def ignore_texts(root: str) -> list[tuple[str, str]]:
    """(folder, text) of every ignore file below ``root``, from the root down, and of the repository's own list of exclusions."""
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in VERSION_CONTROL)
        if IGNORE_FILE in files:
            out.append((os.path.relpath(folder, root).replace(os.sep, "/").removeprefix("."), _text(os.path.join(folder, IGNORE_FILE))))
    out.append(("", _text(os.path.join(root, ".git", "info", "exclude"))))
    return [(f, t) for f, t in out if t]


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def is_interesting(name: str) -> bool:
    return re.match(_python(INTERESTING), name.lower()) is not None


def walk(root: str, hidden: bool = False, ignore: Ignore | None = None, skip: Callable[[str], bool] | None = None) -> Iterator[tuple[str, int]]:
    """(path below ``root``, size) of the regular files that a scan reads, in order of name.

    Links and what can't be read are left out; version-control folders always, dot folders and dull dot files unless
    ``hidden``; what ``ignore`` hides or ``skip`` names (folders with a slash at the end), with all below.
    """

    def visit(folder: str, prefix: str) -> Iterator[tuple[str, int]]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path, dotted = prefix + e.name, e.name.startswith(".")
            if e.is_dir(follow_symlinks=False):
                dull = e.name in VERSION_CONTROL or dotted and not hidden
                if not (dull or ignore and ignore.hides(path, True) or skip and skip(path + "/")):
                    yield from visit(e.path, path + "/")
            elif e.is_file(follow_symlinks=False):
                dull = dotted and not hidden and not is_interesting(e.name)
                if not (dull or ignore and ignore.hides(path, False) or skip and skip(path)):
                    try:
                        yield path, e.stat(follow_symlinks=False).st_size
                    except OSError:
                        continue

    yield from visit(root, "")
