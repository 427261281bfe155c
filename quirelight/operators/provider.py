"""Providers: what turns the segments of a batch into answers, with pacing, retries and a failure guard.

Three kinds of provider are known by what they can do:

* a plain callable takes the sources and gives as many answers, or a raw reply that holds them;
* ``complete(Request) -> Completion`` is instructed by a prompt and answers in JSON;
* ``translate(sources, markup) -> Completion`` is handed the segments as they are.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from quirelight.functions.markup import parse_reply

COUNTERS = ("input", "output", "cache_read", "cache_write")


class ProviderError(Exception):
    """A failed call; ``status`` is the service's, None if there was no answer."""

    def __init__(self, message: str, status: int | None = None, kind: str = "") -> None:
        super().__init__(message)
        self.status = status
        self.kind = kind


class Refused(Exception):
    """The model declined to answer."""


class Truncated(Exception):
    """The answer ended before it was complete; fewer segments may fit."""


class Aborted(Exception):
    """The run can't go on."""


@dataclass(frozen=True)
class Usage:
    """Tokens of an answer; None where the service says nothing."""

    input: int | None = None
    output: int | None = None
    cache_read: int | None = None
    cache_write: int | None = None

    def __add__(self, other: Usage) -> Usage:
        """Unknown counts are left out; the sum is known as soon as one is."""
        both = [(getattr(self, c), getattr(other, c)) for c in COUNTERS]
        return Usage(*[None if a is b is None else (a or 0) + (b or 0) for a, b in both])


@dataclass(frozen=True)
class Request:
    system: str
    user: str
    max_tokens: int = 16_000
    schema: dict | None = None


@dataclass(frozen=True)
class Completion:
    """``text`` of a prompted answer, or ``answers`` of a direct one."""

    text: str = ""
    usage: Usage = Usage()
    answers: tuple[str, ...] = ()


class Provider(Protocol):
    """One call: as many answers as sources, or a raw reply that holds them."""

    def __call__(self, sources: Sequence[str]) -> list[str] | str: ...


def capitals(sources: Sequence[str]) -> list[str]:
    """The offline default: ASCII letters outside tags and references in capitals."""
    return [_capitals(s) for s in sources]


def _capitals(text: str) -> str:
    table = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out, at = [], 0
    for c in ("<", "&"):
        if c in text:
            break
    else:
        return text.translate(table)
    while at < len(text):
        close = {"<": ">", "&": ";"}.get(text[at])
        end = text.find(close, at) if close else -1
        if end >= 0:
            out.append(text[at : end + 1])
            at = end + 1
        else:
            out.append(text[at].translate(table))
            at += 1
    return "".join(out)


REGISTRY: dict[str, Callable[[], Provider]] = {"capitals": lambda: capitals}


def fatal(status: int | None) -> bool:
    return status in (401, 403, 404)


def retryable(status: int | None) -> bool:
    return status is None or status in (408, 409, 429) or status >= 500


def retryable_error(error: BaseException) -> bool:
    """Whether the same request may succeed later: not a refusal, a cut answer, an interruption or a rejected request; all else."""
    if isinstance(error, (Refused, Truncated, Aborted, KeyboardInterrupt)):
        return False
    return retryable(error.status) if isinstance(error, ProviderError) else isinstance(error, Exception)


def interval(requests_per_minute: int, partitions: int = 1) -> float:
    """Seconds between the requests of one of ``partitions`` that share a rate; 0 without a rate."""
    return 60.0 / requests_per_minute * partitions if requests_per_minute > 0 else 0.0


@dataclass
class Limiter:
    """Slots at least ``gap`` seconds apart; idle time is not banked.

    Of p tasks that share a schedule each starts one slot after the other and takes every p-th; ``fixed`` slots are never taken
    late, so that no task runs into the slots of the others.
    """

    gap: float = 0.0
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    next: float = 0.0
    last: float = 0.0
    fixed: bool = False

    def wait(self) -> float:
        now = self.now()
        at = max(now, self.next)
        if self.fixed and self.gap > 0 and now > self.next:
            at = self.next + math.ceil((now - self.next) / self.gap) * self.gap
        self.next, self.last = at + self.gap, at
        if at > now:
            self.sleep(at - now)
        return at


@dataclass
class Runner:
    """Calls a provider on batches: paced, retried with doubling waits, split where the answer can't be used.

    ``prompt(sources, second)`` builds the request for providers that are instructed; ``second`` marks an answer that is asked
    for again.  ``messages`` gathers what happened on the way, ``remarks`` what the usable answers asked to pass on.
    """

    provider: Provider
    attempts: int = 4
    base_wait: float = 2.0
    answer_attempts: int = 2
    failure_limit: int = 6
    limiter: Limiter = field(default_factory=Limiter)
    sleep: Callable[[float], None] = time.sleep
    prompt: Callable[[Sequence[str], bool], Request] | None = None
    calls: int = 0
    usable: int = 0
    streak: int = 0
    usage: Usage = Usage()
    remarks: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    last_error: str = ""

    def _attempt(self, sources: Sequence[str], markup: bool, second: bool) -> list[str] | str:
        if hasattr(self.provider, "translate"):
            done = self.provider.translate(sources, markup)
            self.usage += done.usage
            return list(done.answers)
        if hasattr(self.provider, "complete"):
            done = self.provider.complete(self.prompt(sources, second))
            self.usage += done.usage  # spent, whether or not the answer can be used
            return done.text
        return self.provider(sources)

    def _call(self, sources: Sequence[str], markup: bool, second: bool) -> list[str] | str:
        for k in range(max(1, self.attempts)):
            self.limiter.wait()
            self.calls += 1
            try:
                return self._attempt(sources, markup, second)
            except Exception as e:
                if isinstance(e, ProviderError) and fatal(e.status):
                    raise Aborted(str(e)) from e
                if not retryable_error(e) or k + 1 >= self.attempts:
                    raise
                wait = self.base_wait * 2**k
                wait += random.uniform(0, wait / 2)
                self.messages.append(f"attempt {k + 1} failed: {e}")
                self.sleep(wait)
        raise ProviderError("no attempt allowed")

    def _guard(self) -> None:
        self.streak += 1
        if 0 < self.failure_limit <= self.streak:
            raise Aborted(f"{self.streak} failures in a row: {self.last_error}")

    def answers(self, sources: Sequence[str], markup: Sequence[bool] | None = None, second: bool = False) -> list[str | None]:
        """One answer a source; None where none could be had."""
        if not sources:
            return []
        direct = hasattr(self.provider, "translate")
        failed = False  # the service, not the answer
        for _ in range(1 if direct else self.answer_attempts):
            try:
                reply = self._call(sources, bool(markup and any(markup)), second)
            except Aborted:
                raise
            except Exception as e:
                self.last_error, failed = str(e) or type(e).__name__, True
                break
            got, remarks = parse_reply(reply) if isinstance(reply, str) else (list(reply), [])
            if got is not None and len(got) == len(sources):
                self.usable += 1
                self.streak = 0
                self.remarks += remarks
                return got
            self.last_error = f"{0 if got is None else len(got)} answers to {len(sources)} strings"
            self.messages.append(self.last_error)
        half = len(sources) // 2
        if failed or not half:
            self._guard()
        if not half:
            return [None]
        if failed and not self.splits_failures:
            return [None] * len(sources)
        return self.answers(sources[:half], markup and markup[:half], second) + self.answers(sources[half:], markup and markup[half:], second)

    #: Whether a batch whose call failed is halved too, as one with an unusable answer is.
    splits_failures: bool = True
