"""Calls to a remote model from within a task: several under way at once, in order, each with a time-out.

A task keeps a window of calls open on an event loop of its own thread. An asynchronous method is awaited and, past
its time, cancelled; a plain one runs in a daemon thread of its own and is left behind. Results come in the order
of the rows, whatever order the answers have. Calls that have no time limit and go one after another, as those to a
translator within the worker, are made in the task's own thread.
"""

from __future__ import annotations

import asyncio
import http.client
import inspect
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

ATTEMPTS, FIRST_PAUSE = 3, 0.6
TIMEOUT, CONNECT_TIMEOUT = 60.0, 10.0
#: Plain calls of one task that may hang, left behind, before further ones fail at once.
MOST_HUNG = 64


@dataclass(frozen=True)
class Calls:
    """``callers`` tasks (None: as many as there are partitions) with ``window`` calls each under way: so many calls at
    once in the whole cluster as the two multiply to. Without ``timeout`` a call may take as long as it likes."""

    callers: int | None = None
    window: int = 1
    timeout: float | None = TIMEOUT
    attempts: int = ATTEMPTS
    pause: float = FIRST_PAUSE


#: Six calls at once to a remote model.
REMOTE = Calls(callers=2, window=3)
OFFLINE = Calls(timeout=None)


@dataclass(frozen=True)
class Answer:
    value: Any
    error: str | None = None


class Window:
    """Runs calls on an event loop in a thread of its own; ``close`` ends it, and what still hangs with it. Plain calls
    without a time limit, one at a time, need neither."""

    def __init__(self, calls: Calls):
        self.calls, self.hung, self.lock = calls, 0, threading.Lock()
        self.here = calls.timeout is None and calls.window == 1
        self.loop = asyncio.new_event_loop()
        self.thread = threading.Thread(target=self.loop.run_forever, daemon=True)
        self.thread.start()

    def ordered(self, asked: Iterable[tuple]) -> Iterator[Answer]:
        """The answers to ``asked``, (method, arguments...) each, in that order. As many are under way as the window is
        wide, and ``asked`` is read no further than that."""
        open_calls: deque = deque()
        for call in asked:
            if self.here and not inspect.iscoroutinefunction(call[0]):
                yield self._here(*call)
                continue
            open_calls.append(asyncio.run_coroutine_threadsafe(self._answer(*call), self.loop))
            if len(open_calls) >= self.calls.window:
                yield open_calls.popleft().result()
        while open_calls:
            yield open_calls.popleft().result()

    def _here(self, method: Callable, *args: Any) -> Answer:
        for attempt in range(self.calls.attempts):
            try:
                return Answer(method(*args))
            except Exception as error:
                failure = error
            if attempt + 1 < self.calls.attempts:
                time.sleep(self.calls.pause * 2**attempt)
        return Answer(None, str(failure) or type(failure).__name__)

    async def _answer(self, method: Callable, *args: Any) -> Answer:
        for attempt in range(self.calls.attempts):
            try:
                return Answer(await asyncio.wait_for(self._started(method, args), self.calls.timeout))
            except TimeoutError as late:
                failure: Exception = TimeoutError(str(late) or f"no answer in {self.calls.timeout:g} s" if self.calls.timeout else "no answer in time")
            except Exception as error:
                failure = error
            if attempt + 1 < self.calls.attempts:
                await asyncio.sleep(self.calls.pause * 2**attempt)
        return Answer(None, str(failure) or type(failure).__name__)

    async def _started(self, method: Callable, args: tuple) -> Any:
        if inspect.iscoroutinefunction(method):
            return await method(*args)
        if self.hung >= MOST_HUNG:
            raise RuntimeError(f"{MOST_HUNG} calls hang")
        done = self.loop.create_future()

        def tell(result: Any, error: BaseException | None) -> None:
            if not done.done():
                done.set_result(result) if error is None else done.set_exception(error)

        def run() -> None:
            result = error = None
            try:
                result = method(*args)
            except Exception as failure:
                error = failure
            with self.lock:
                self.hung -= left[0]
                ended[0] = True
            if not self.loop.is_closed():
                self.loop.call_soon_threadsafe(tell, result, error)

        left, ended = [0], [False]
        threading.Thread(target=run, daemon=True).start()
        try:
            return await done
        except asyncio.CancelledError:
            with self.lock:
                if not ended[0]:
                    left[0] = 1
                    self.hung += 1
            raise

    def close(self) -> None:
        def stop() -> None:
            for task in asyncio.all_tasks(self.loop):
                task.cancel()
            self.loop.call_soon(self.loop.stop)

        self.loop.call_soon_threadsafe(stop)
        self.thread.join(1)


class ChatTranslator:
    """A model behind an endpoint of chat completions. ``key`` stays in the worker: it is part of no table and no error.

    Ten seconds to connect, sixty for an answer; retries and the window are the caller's.
    """

    def __init__(self, url: str, key: str, model: str, temperature: float = 0.3, timeout: float = TIMEOUT, connect_timeout: float = CONNECT_TIMEOUT):
        self.url, self.key, self.model, self.temperature = urlsplit(url), key, model, temperature
        self.timeout, self.connect_timeout = timeout, connect_timeout

    def ask(self, system: str, text: str) -> str:
        body = json.dumps({"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}]})
        kind = http.client.HTTPSConnection if self.url.scheme == "https" else http.client.HTTPConnection
        line = kind(self.url.hostname, self.url.port, timeout=self.connect_timeout)
        try:
            line.connect()
            line.sock.settimeout(self.timeout)
            line.request("POST", f"{self.url.path.rstrip('/')}/chat/completions", body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            reply = line.getresponse()
            answer = reply.read()
        finally:
            line.close()
        if reply.status != 200:
            raise RuntimeError(f"the model answered {reply.status}")
        return json.loads(answer)["choices"][0]["message"]["content"].strip()

    def translate(self, text: str, terms: Mapping[str, str], instruction: str = "") -> str:
        """Only those terms are told that the text holds."""
        held = "\n".join(f"{cn} → {en}" for cn, en in terms.items() if cn in text)
        told = ["You translate Chinese business documents into English. Keep tokens like __G0__ as they are; answer with the translation alone."]
        told += [f"Use these terms:\n{held}"] if held else []
        told += [instruction] if instruction else []
        return self.ask("\n\n".join(told), text)

    def polish(self, text: str) -> str:
        return self.ask("Make this English text read well. Keep its meaning and every token like __G0__; answer with the text alone.", text)
