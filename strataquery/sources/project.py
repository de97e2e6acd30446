"""Project markers, Git state and the identities that follow from them."""

from __future__ import annotations

import hashlib
import json
import subprocess
import tomllib
import uuid
from dataclasses import dataclass, field
from pathlib import Path

MARKER = ".strataquery/project.toml"
SLOT_KEY = "slot-v1"


@dataclass(frozen=True)
class Project:
    id: str
    name: str
    root: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    largest: int = 1_048_576

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps({"include": list(self.include), "exclude": list(self.exclude), "largest": self.largest}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def find_root(start: Path) -> Path | None:
    """The nearest folder, from ``start`` upwards, with a marker."""
    start = start.expanduser().resolve()
    return next((p for p in (start, *start.parents) if (p / MARKER).is_file()), None)


def read_marker(root: Path) -> Project:
    with open(root / MARKER, "rb") as file:
        data = tomllib.load(file)
    scan = data.get("scan", {})
    return Project(data["id"], data["name"], str(root), tuple(scan.get("include", ())), tuple(scan.get("exclude", ())), scan.get("max_file_bytes", 1_048_576))


def write_marker(root: Path, name: str | None = None, force_new_id: bool = False) -> Project:
    """Create the marker, or read the one that there is unless a new id is forced."""
    path = root / MARKER
    if path.is_file() and not force_new_id:
        return read_marker(root)
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [f'id = "{uuid.uuid4()}"', f"name = {json.dumps(name or root.name)}", "", "[scan]", "include = []", "exclude = []", "max_file_bytes = 1048576", ""]
    part = path.with_suffix(".part")
    part.write_text("\n".join(lines))
    part.replace(path)
    return read_marker(root)


@dataclass(frozen=True)
class GitState:
    repository: str = ""
    checkout: str = ""
    prefix: str = ""
    kind: str = "none"  # branch, detached or none
    value: str = ""
    head: str = ""
    dirty: tuple[str, ...] | None = field(default=None)

    @property
    def fingerprint(self) -> str | None:
        """Digest of the changed paths, in order."""
        return None if self.dirty is None else hashlib.sha256("\0".join(sorted(self.dirty)).encode()).hexdigest()


def _git(root: Path, *arguments: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", str(root), *arguments], capture_output=True, timeout=10, check=True).stdout.decode("utf-8", "surrogateescape").rstrip("\n")
    except (OSError, subprocess.SubprocessError):
        return None


def git_state(root: Path, status: bool = False) -> GitState:
    """Where the folder stands in Git; all empty outside a worktree."""
    top = _git(root, "rev-parse", "--show-toplevel")
    if top is None:
        return GitState()
    common = _git(root, "rev-parse", "--path-format=absolute", "--git-common-dir") or ""
    head = _git(root, "rev-parse", "--verify", "-q", "HEAD") or ""
    branch = _git(root, "symbolic-ref", "-q", "HEAD")
    prefix = (_git(root, "rev-parse", "--show-prefix") or "").rstrip("/")
    dirty = None
    if status:
        listed = _git(root, "status", "--porcelain=v1", "-z", "--", ".")
        dirty = tuple(x for x in (listed or "").split("\0") if x)
    return GitState(common, top, prefix, "branch" if branch else "detached", branch or head, head, dirty)


def slot_id(project_id: str, state: GitState) -> str:
    """One slot a branch (or detached commit) of a checkout; commits and edits don't change it."""
    key = (SLOT_KEY, project_id, state.repository, state.checkout, state.prefix, state.kind, state.value)
    return hashlib.sha256(json.dumps(key, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def partition_id(slot: str) -> str:
    return f"slot-{slot[:32]}"


def overlap(a: str, b: str) -> str | None:
    """How root ``a`` lies to root ``b``: same, contains, nested or not at all."""
    x, y = Path(a).resolve(), Path(b).resolve()
    if x == y:
        return "same"
    return "contains" if x in y.parents else "nested" if y in x.parents else None
