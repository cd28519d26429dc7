"""Running external tools and keeping their results: processes, tool lookup, cache folders, atomic outputs."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import threading
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from ..operators.errors import CheckFailed, MediaError

TAIL = 20
OK, ERROR, USAGE, STOPPED = 0, 1, 2, 3


@dataclass
class Result:
    stdout: str
    stderr: str


class ToolFailed(MediaError):
    """A tool's command line, exit code and the last lines it wrote to its standard error."""

    def __init__(self, command: Sequence[str], code: int, stderr: str):
        super().__init__(f"{' '.join(command)} ended with {code}\n" + "\n".join(stderr.splitlines()[-TAIL:]))


Runner = Callable[[Sequence[str], Path], Result]


def run(command: Sequence[str], cwd: Path) -> Result:
    done = subprocess.run([str(c) for c in command], cwd=cwd, capture_output=True, text=True, errors="replace", stdin=subprocess.DEVNULL)
    if done.returncode:
        raise ToolFailed([str(c) for c in command], done.returncode, done.stderr)
    return Result(done.stdout, done.stderr)


@contextmanager
def streaming(command: Sequence[str], cwd: Path):
    """A process whose output is read while it runs; its standard error is drained on a thread, and it is stopped if the reader fails."""
    p = subprocess.Popen([str(c) for c in command], cwd=cwd, stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL)
    lines: list[bytes] = []
    drain = threading.Thread(target=lambda: lines.extend(p.stderr), daemon=True)
    drain.start()
    try:
        yield p.stdout
    except BaseException:
        p.kill()
        raise
    finally:
        p.stdout.close()
        code = p.wait()
        drain.join()
    if code:
        raise ToolFailed([str(c) for c in command], code, b"".join(lines).decode("utf-8", "replace"))


def find_tool(name: str) -> Path:
    found = shutil.which(name)
    if not found:
        raise CheckFailed("tool_not_found", f"{name}; looked in {os.environ.get('PATH', '')}")
    return Path(found)


def index_enabled(log: str) -> bool | None:
    """What a detector's log says about its use of the frame index, if it says it."""
    m = re.search(r"dtvindex=(enabled|disabled)", log)
    return m and m[1] == "enabled" or (False if m else None)


def packet_arguments(stream: str, entries: str) -> list[str]:
    """Arguments that make a prober list packets; hashes are asked for where the entries need them."""
    hashes = ["-show_data_hash", "CRC32"] if "data_hash" in entries else []
    return ["-v", "error", "-select_streams", stream, *hashes, "-show_entries", f"packet={entries}", "-of", "csv=p=0"]


def packet_rows(prober: str, target: str, stream: str, entries: str, runner: Runner = run) -> list[str]:
    rows = [x.strip() for x in runner([prober, *packet_arguments(stream, entries), target], Path.cwd()).stdout.splitlines()]
    rows = [x for x in rows if x]
    if not rows:
        raise CheckFailed("no_packets", f"{target} {stream}")
    return rows


def name_hash(data: bytes) -> str:
    """64-bit FNV-1a in hex."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def stem_name(stem: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f-\x9f/\s]", "_", stem)[:80]


@dataclass
class Cache:
    """Where an input's intermediate files are: ``<root>/<hash>-<stem>``. The hash covers path, size and time of change."""

    folder: Path

    @classmethod
    def of(cls, source: Path, root: Path | None = None) -> Cache:
        root = root or Path(os.environ.get("XDG_CACHE_HOME", Path.home() / ".cache")) / "framewise"
        s = source.stat()
        return cls(root.absolute() / f"{name_hash(f'{source.absolute()}\0{s.st_size}\0{s.st_mtime_ns}'.encode())}-{stem_name(source.stem)}")

    def make(self) -> Cache:
        self.folder.mkdir(parents=True, exist_ok=True)
        return self

    def link(self, source: Path) -> Path:
        """A link to the input under a fixed name, made anew."""
        at = self.folder / f"work{source.suffix}"
        at.unlink(missing_ok=True)
        at.symlink_to(source.absolute())
        return at

    def __getattr__(self, name: str) -> Path:
        files = {"index": "work.dtvi", "scenes": "scp.txt", "trim": "trim.avs", "structure": "detail.jls", "presence": "logoframe.txt", "segment_map": "segments.json", "ass": "subs.ass", "srt": "subs.srt", "prepared": "prepared.mp4"}
        if name not in files:
            raise AttributeError(name)
        return self.folder / files[name]

    def subtitles(self) -> Path:
        """The cached subtitles, ASS before SRT."""
        found = next((p for p in (self.ass, self.srt) if p.exists()), None)
        if not found:
            raise CheckFailed("no_subtitles", str(self.folder))
        return found

    def clear(self, *names: str) -> None:
        """Stale results go before work begins, so that they can't be taken for new ones."""
        for n in names:
            getattr(self, n).unlink(missing_ok=True)


def resolve(explicit: Path | None, cached: Path, what: str) -> Path:
    """A file that was named, or else the cached one, or an error that names both."""
    if explicit:
        return explicit
    if cached.exists():
        return cached
    raise CheckFailed(f"no_{what}", f"give one, or make {cached}")


def pending(output: Path) -> Path:
    return output.with_name(f".{output.name}.{os.getpid()}.tmp")


@contextmanager
def published(*outputs: Path):
    """Temporary names in the outputs' folders; all are renamed if the block succeeds, and removed if not."""
    temps = [pending(o) for o in outputs]
    try:
        yield temps
        for t, o in zip(temps, outputs, strict=True):
            t.replace(o)
    finally:
        for t in temps:
            t.unlink(missing_ok=True)


def same_path(a: Path, b: Path) -> bool:
    real = lambda p: p.resolve() if p.exists() else p.parent.resolve() / p.name
    return real(a) == real(b)


def cut_name(source: Path, suffix: str) -> Path:
    return source.with_name(f"{source.stem}_CMcut{suffix}")


def reject_dash(path: Path | str, flag: str) -> None:
    if str(path) == "-":
        raise CheckFailed("dash_output", f"{flag} needs a file that can be sought")


def variables(defaults: Sequence[tuple[str, str]], overrides: Sequence[tuple[str, str]]) -> list[str]:
    """Detector variables: defaults in their order, overridden where named again, then the rest."""
    merged = dict(defaults) | dict(overrides)
    return [x for k, v in merged.items() for x in ("-set", k, v)]


def parse_variable(raw: str) -> tuple[str, str]:
    key, eq, value = raw.partition("=")
    if not eq or not key:
        raise ValueError(f"{raw!r} isn't KEY=VALUE")
    return key, value


def parse_rect(raw: str) -> tuple[int, int, int, int]:
    parts = raw.split(",")
    if len(parts) != 4 or not all(p.strip().isdigit() for p in parts):
        raise ValueError(f"{raw!r} isn't X,Y,W,H")
    return tuple(int(p) for p in parts)  # type: ignore[return-value]


def even_rect(rect: tuple[int, int, int, int]) -> tuple[tuple[int, int, int, int], str | None]:
    out = tuple(v - v % 2 for v in rect)
    return out, (None if out == rect else f"rectangle {rect} becomes {out}")  # type: ignore[return-value]
