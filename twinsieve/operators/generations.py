"""Versioned index folders with a state each, and one pointer to the active one.

A generation is built in its own folder and read only after activation. Pointers and states are numbered
files of which the highest counts: each is written under another name and renamed to a number that is not
there yet, so a reader finds the old or the new value at any moment, and of two writers one fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinsieve.functions.scalars import valid_generation
from twinsieve.operators.metrics import progress
from twinsieve.params import DEFAULTS, Params
from twinsieve.session import folders

BUILDING, READY, DEGRADED = "building", "ready", "degraded"
KEPT = 3
REASON_LENGTH = 500


@dataclass(frozen=True)
class Prewrite:
    """What became of writing to the index before a document is stored."""

    status: str
    generations: tuple[str, ...] = ()
    error: str | None = None

    @property
    def attempted(self) -> bool:
        return self.status != "skipped"

    @property
    def succeeded(self) -> bool:
        return self.status != "degraded"


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- numbered files -------------------------------------------------------------------------

    def _numbers(self, name: str) -> list[int]:
        at = self._p(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit())

    def _read(self, name: str) -> dict | None:
        numbers = self._numbers(name)
        if not numbers:
            return None
        stream = self._fs.open(self._p(f"{self.path}/{name}/{numbers[-1]:08d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        numbers = self._numbers(name)
        new = self._p(f"{self.path}/{name}/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        at = self._p(f"{self.path}/{name}/{(numbers[-1] if numbers else 0) + 1:08d}")
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise OSError(f"another writer changed {name}")
        for old in numbers[: -KEPT + 1]:
            self._fs.delete(self._p(f"{self.path}/{name}/{old:08d}"), False)

    # -- states ---------------------------------------------------------------------------------

    def folder(self, generation: str) -> str:
        return f"{self.path}/{valid_generation(generation)}"

    def status(self) -> dict:
        """Both pointers, read at once from one file: no reader can miss a generation that moves."""
        now = self._read("pointers") or {}
        return {"active": now.get("active"), "building": now.get("building")}

    def meta(self, generation: str) -> dict | None:
        """State, parameters, tables written and progress of a generation."""
        found = self._read(f"state-{valid_generation(generation)}")
        return None if found is None or found.get("removed") else found

    def _state(self, generation: str, state: str, **more) -> None:
        self._write(f"state-{generation}", (self.meta(generation) or {}) | {"state": state} | more)

    def begin(self, generation: str, p: Params = DEFAULTS) -> None:
        """One builder at a time. The building generation itself may begin again, as after a failure."""
        now = self.status()
        known = self.meta(valid_generation(generation))
        if now["building"] not in (None, generation):
            raise ValueError(f"generation {now['building']} is being built")
        if generation == now["active"] or (known and known["state"] == READY and now["building"] is None):
            raise ValueError("a generation of this name exists")
        if known and known["params"] != p.meta():
            raise ValueError(f"the generation was begun with {known['params']}")
        self._state(generation, BUILDING, params=p.meta(), reason=None)
        self._write("pointers", now | {"building": generation})

    def build(self, generation: str, tables: dict[str, DataFrame], p: Params = DEFAULTS, report: Callable[[dict], None] | None = None) -> None:
        """Writes the tables in the given order; a failure leaves the generation degraded.

        Building it again goes on after the tables that are complete. ``report`` gets the progress after
        each table (B13): table, rows, tables done and expected, seconds left.
        """
        self.begin(generation, p)
        began, complete = time.time(), {f.rpartition("/")[2] for f in folders(self.spark, self.folder(generation), "")}
        try:
            for done, (name, df) in enumerate(tables.items(), 1):
                path = f"{self.folder(generation)}/{name}"
                if name not in complete:
                    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
                now = {"table": name, "rows": self.spark.read.parquet(path).count(), "tables_done": done} | progress(done, len(tables), time.time() - began)
                self._state(generation, BUILDING, progress=now)
                if report:
                    report(now)
        except Exception as e:
            self.degrade(generation, str(e))
            raise
        self._state(generation, READY, tables=list(tables))

    def degrade(self, generation: str, reason: str = "") -> None:
        self._state(generation, DEGRADED, reason=reason[:REASON_LENGTH])

    def active_ready(self) -> str | None:
        active = self.status()["active"]
        return active if active and (self.meta(active) or {}).get("state") == READY else None

    def writable(self) -> list[str]:
        """The active generation if ready, and the building one if building or ready."""
        now, out = self.status(), []
        if now["active"] and (self.meta(now["active"]) or {}).get("state") == READY:
            out.append(now["active"])
        if now["building"] and now["building"] not in out and (self.meta(now["building"]) or {}).get("state") in (BUILDING, READY):
            out.append(now["building"])
        return out

    def prewrite(self, write: Callable[[str], None]) -> Prewrite:
        """Runs ``write`` for the folder of every writable generation, before documents are stored.

        A failure degrades all of them, so that nobody trusts an index that lacks a document; if that
        cannot be recorded either, the error is raised and the documents must not be stored.
        """
        chosen = self.writable()
        if not chosen:
            return Prewrite("skipped")
        try:
            for generation in chosen:
                write(self.folder(generation))
        except Exception as e:
            try:
                for generation in chosen:
                    self.degrade(generation, str(e))
            except Exception as second:
                raise RuntimeError("the index could not be written nor degraded") from second
            return Prewrite("degraded", tuple(chosen), str(e))
        return Prewrite("success", tuple(chosen))

    def activate(self, generation: str) -> None:
        """Only the generation just built, and only when ready; both pointers change in one step."""
        if self.status()["building"] != valid_generation(generation) or (self.meta(generation) or {}).get("state") != READY:
            raise ValueError("only a ready generation that is being built can be activated")
        self._write("pointers", {"active": generation, "building": None})

    def read(self, name: str, generation: str | None = None) -> DataFrame:
        found = generation or self.status()["active"]
        if not found:
            raise ValueError("no generation is active")
        return self.spark.read.parquet(f"{self.folder(found)}/{name}")

    def cleanup(self, generation: str) -> None:
        """Removes a generation. The active one, and the one being built unless it is degraded, cannot go."""
        now = self.status()
        failed = now["building"] == valid_generation(generation) and (self.meta(generation) or {}).get("state") == DEGRADED
        if generation == now["active"] or (generation == now["building"] and not failed):
            raise ValueError("the generation is in use")
        if failed:
            self._write("pointers", now | {"building": None})
        self._fs.delete(self._p(self.folder(generation)), True)
        self._write(f"state-{generation}", {"removed": True})
