"""Error classes by area; ``kind`` is the class name that callers and tests check."""

from __future__ import annotations

import re
from contextlib import contextmanager


class EngineError(Exception):
    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind

    def __reduce__(self):
        return type(self), (self.kind, str(self).partition(": ")[2])


class TokenError(EngineError):
    pass


class CodecError(EngineError):
    pass


class ArtifactError(EngineError):
    pass


class ManifestError(EngineError):
    pass


class SourceError(EngineError):
    pass


class RunError(EngineError):
    pass


_raised = re.compile(r"pairloom\.errors\.(\w+): (\w+)(?:: ([^\r\n]*))?")


@contextmanager
def unwrapped():
    """An engine error that a task has raised comes out as itself, not as Spark's report of it."""
    try:
        yield
    except EngineError:
        raise
    except Exception as e:
        found = _raised.search(str(e))
        kind = globals().get(found[1]) if found else None
        if not (isinstance(kind, type) and issubclass(kind, EngineError)):
            raise
        raise kind(found[2], found[3] or "") from e
