"""Messages among the tasks of a barrier stage.

Spark's own allGather looks for the others' messages once a second, which is too slow for thousands of rounds. Where the tasks
see one folder (spark.checkpoint.dir, or one machine's folder for temporary files), messages are files in it; elsewhere they take Spark's way.
"""

from __future__ import annotations

import base64
import os
import tempfile
import time

from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Seconds without a message of another task, after which a task gives up.
PATIENCE = 900.0


def folder(spark: SparkSession) -> str:
    """The folder that executors share as far as the driver knows."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    at = at.removeprefix("file://").removeprefix("file:")
    return at.rstrip("/") if at.startswith("/") else tempfile.gettempdir()


class Exchange:
    """gather(message) gives the messages of all tasks, in order of tasks. All tasks must call it equally often."""

    def __init__(self, at: str):
        context = BarrierTaskContext.get()
        self._context, self.task, self.tasks = context, context.partitionId(), len(context.getTaskInfos())
        self._at, self._name, self._round = at, "", 0
        own = f"{at}/{context.taskAttemptId()}"
        try:
            os.makedirs(at, exist_ok=True)
            with open(own, "wb"):
                pass
        except OSError:
            pass
        ids = context.allGather(str(context.taskAttemptId()))
        self._name = ids[0]  # a repeated stage has other names
        seen = all(os.path.exists(f"{at}/{k}") for k in ids)
        self._files = all(x == "1" for x in context.allGather("1" if seen else "0"))

    def _file(self, number: int, task: int) -> str:
        return f"{self._at}/{self._name}-{number}-{task}"

    def _put(self, message: bytes) -> None:
        made = self._file(self._round, self.task)
        with open(f"{made}.part", "wb") as f:
            f.write(message)
        os.rename(f"{made}.part", made)

    def _take(self, task: int) -> bytes:
        begun, pause = time.monotonic(), 0.0002
        while True:
            try:
                with open(self._file(self._round, task), "rb") as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() - begun > PATIENCE:
                    raise TimeoutError(f"task {task} sent nothing for {PATIENCE} s") from None
                time.sleep(pause)
                pause = min(pause * 1.5, 0.003)

    def gather(self, message: bytes) -> list[bytes]:
        if not self._files:
            return [base64.b64decode(m) for m in self._context.allGather(base64.b64encode(message).decode())]
        self._round += 1
        self._put(message)
        out = [message if k == self.task else self._take(k) for k in range(self.tasks)]
        if self._round > 2:  # who wrote this round's message has read those of the last but one
            os.remove(self._file(self._round - 2, self.task))
        return out
