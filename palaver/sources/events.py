"""What parsers emit, and how the events of one file become rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from palaver.functions.tools import activity


@dataclass
class Message:
    role: str
    text: str
    native_id: str = ""
    parent: str | None = None
    timestamp: str | None = None
    is_sidechain: bool = False
    span: tuple[int, int] | None = None
    session: str | None = None  # of sources that hold several


@dataclass
class Parsed:
    """Events of one source in order; ``skipped`` counts records that should have been messages."""

    messages: list[Message] = field(default_factory=list)
    activities: list[tuple[str, str, str, str | None, str, str]] = field(default_factory=list)  # message, kind, name, target, actor, status
    usage: list[tuple[str, tuple[int, int, int, int, int], str]] = field(default_factory=list)  # message, buckets, source
    skipped: int = 0
    notes: list[str] = field(default_factory=list)
    session_id: str | None = None
    session_ids: list[str] = field(default_factory=list)
    cwd: str | None = None
    pair_observed: bool = False
    titles: dict[str | None, str] = field(default_factory=dict)  # by native session; None stands for the source's own
    remote: str | None = None  # of the repository that the session is about

    def entitle(self, native: str | None, title: object) -> None:
        """The last title counts that isn't blank."""
        if isinstance(title, str) and title.strip():
            self.titles[native] = title.strip()

    def skip(self, line: int, why: str) -> None:
        self.skipped += 1
        self.notes.append(f"line {line}: {why}")

    def see_session(self, native: object, cwd: object) -> None:
        """The first session id counts; a folder only with the id that it came with."""
        if not isinstance(native, str) or not native.strip():
            return
        native = native.strip()
        if native not in self.session_ids:
            self.session_ids.append(native)
        self.session_id = self.session_id or native
        if not self.pair_observed and native == self.session_id and isinstance(cwd, str) and cwd.strip():
            self.cwd, self.pair_observed = cwd.strip(), True

    @property
    def id_state(self) -> str:
        return "missing" if not self.session_ids else "ambiguous" if len(self.session_ids) > 1 else "resolved"


class Calls:
    """Tool calls that wait for their results."""

    def __init__(self, parsed: Parsed) -> None:
        self._parsed = parsed
        self._open: list[tuple[str, str, object, str, bool]] = []

    def called(self, call_id: object, name: object, value: object, message: str, sidechain: bool) -> None:
        if isinstance(call_id, str) and call_id.strip() and isinstance(name, str) and name.strip():
            self._open.append((call_id, name, value, message, sidechain))

    def answered(self, call_id: object, failed: bool, message: str | None) -> None:
        """The first open call of the id gets the result, at the message of the result or else its own."""
        for k, (i, name, value, caller, sidechain) in enumerate(self._open):
            if i == call_id:
                del self._open[k]
                self._emit(name, value, message or caller, sidechain, "error" if failed else "success")
                return

    def close(self) -> None:
        for _, name, value, caller, sidechain in self._open:
            self._emit(name, value, caller, sidechain, "unknown")
        self._open = []

    def _emit(self, name: str, value: object, message: str, sidechain: bool, status: str) -> None:
        kind, target = activity(name, value)
        self._parsed.activities.append((message, kind, name, target, "subagent" if sidechain else "main", status))


def block_texts(content: object, kinds: Iterable[str] = ("text",)) -> list[str]:
    """Texts of content that is a string or a list of blocks; a block's text is under its kind."""
    if isinstance(content, str):
        return [content]
    if not isinstance(content, list):
        return []
    out = []
    for block in content:
        if isinstance(block, dict) and block.get("type") in kinds:
            t = block.get("text", block.get(block.get("type")))
            if isinstance(t, str) and t.strip():
                out.append(t)
    return out
