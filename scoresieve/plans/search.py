"""Search for weights: trials stored in SQLite, proposals by a Parzen estimator, selections by Spark."""

from __future__ import annotations

import json
import shlex
import shutil
import sqlite3
import subprocess
import time
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weighting import good_trials, parameter_signature, parameters_of, signature, weights_of
from ..operators.scoring import weighted
from ..plots import history as history_plot
from ..operators.selection import top_k, top_k_heap
from ..operators.trials import SCHEMA, with_duration
from ..sources.files import last_eval_loss, save_best_weights
from ..sources.index import fetch
from ..sources.pool import number_text, put, records, rewritten, write_manifest


@dataclass
class Trial:
    number: int
    state: str = "RUNNING"
    params: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    value: float | None = None
    warmup: bool = False
    start: float | None = None
    complete: float | None = None


class Study:
    """Trials of one name in a SQLite file (sqlite:///path, a path, or :memory:); created where it does not exist."""

    def __init__(self, storage: str, name: str):
        path = storage.removeprefix("sqlite:///")
        if "://" in path:
            raise ValueError("only SQLite storages are supported")
        if path != ":memory:":
            Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.name, self.db = name, sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS trial (study TEXT, number INT, state TEXT, params TEXT, weights TEXT, value REAL, warmup INT, start REAL, complete REAL, PRIMARY KEY (study, number))")

    def trials(self) -> list[Trial]:
        rows = self.db.execute("SELECT number, state, params, weights, value, warmup, start, complete FROM trial WHERE study = ? ORDER BY number", (self.name,))
        return [Trial(n, s, json.loads(p), json.loads(w), v, bool(u), a, b) for n, s, p, w, v, u, a, b in rows]

    def put(self, t: Trial) -> Trial:
        self.db.execute("INSERT OR REPLACE INTO trial VALUES (?,?,?,?,?,?,?,?,?)", (self.name, t.number, t.state, json.dumps(t.params), json.dumps(t.weights), t.value, int(t.warmup), t.start, t.complete))
        self.db.commit()
        return t

    def add(self, **known) -> Trial:
        number = self.db.execute("SELECT coalesce(max(number), -1) + 1 FROM trial WHERE study = ?", (self.name,)).fetchone()[0]
        return self.put(Trial(number, **known))

    def best(self) -> Trial | None:
        done = [t for t in self.trials() if t.state == "COMPLETE" and t.value is not None]
        return min(done, key=lambda t: (t.value, t.number), default=None)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The trials as a table, see ``operators.trials``."""
        at = lambda x: None if x is None else datetime.fromtimestamp(x, UTC)
        rows = [(t.number, t.state, t.value, t.weights, t.warmup, t.params, at(t.start), at(t.complete)) for t in self.trials()]
        return with_duration(spark.createDataFrame(rows, SCHEMA))


@dataclass
class Settings:
    keys: Sequence[str]
    k: int
    method: str = "softmax"
    span: tuple[float, float] = (-5.0, 5.0)
    seed: int = 42
    startup: int = 0
    candidates: int = 500
    joint: bool = False
    gamma_share: float = 0.1
    gamma_most: int = 25
    patience: int = 0
    delta: float = 0.0
    timeout_hours: float = 24.0
    gamma: Callable[[int], int] | None = None
    exact_ties: bool = False


def _state_signatures(trials: list[Trial], s: Settings, now: float) -> dict[str, set]:
    found: dict[str, set] = {"COMPLETE": set(), "WAITING": set(), "RUNNING": set(), "FAIL": set()}
    for t in trials:
        state = t.state
        if state == "RUNNING" and t.start is not None and now - t.start > s.timeout_hours * 3600:
            state = "FAIL"
        own = parameter_signature(t.params, s.keys, s.method, s.span) if t.params else signature(t.weights, s.keys)
        found.setdefault(state, set()).add(own)
        if t.weights and t.warmup:
            found[state].add(signature(t.weights, s.keys))
    return found


def inject_warmup(study: Study, entries: Sequence[tuple[Mapping[str, float], float]], s: Settings) -> int:
    """Add finished trials that were run elsewhere, each signature once; returns how many."""
    seen = _state_signatures(study.trials(), s, time.time())["COMPLETE"]
    n = 0
    for weights, loss in entries:
        own = signature(weights, s.keys)
        if own in seen:
            continue
        total = sum(weights.values()) or 1.0
        shares = {k: weights.get(k, 0.0) / total for k in s.keys}
        study.add(state="COMPLETE", params=parameters_of(shares, s.keys, s.method, s.span), weights=shares, value=float(loss), warmup=True, start=time.time(), complete=time.time())
        seen.add(own)
        n += 1
    return n


def enqueue(study: Study, entries: Sequence[Mapping[str, float]], s: Settings) -> dict[str, int]:
    """Queue weights to be tried first, unless their signature is done, queued or running; failed and stuck ones are tried again."""
    seen = _state_signatures(study.trials(), s, time.time())
    counts = dict.fromkeys(("new", "retry", "complete", "waiting", "running"), 0)
    for weights in entries:
        total = sum(weights.values()) or 1.0
        shares = {k: weights.get(k, 0.0) / total for k in s.keys}
        params = parameters_of(shares, s.keys, s.method, s.span)
        both = {signature(weights, s.keys), parameter_signature(params, s.keys, s.method, s.span)}  # what was asked for, and what the range lets it become
        held = next((state for state in ("COMPLETE", "WAITING", "RUNNING") if both & seen[state]), None)
        if held:
            counts[held.lower()] += 1
            continue
        counts["retry" if both & seen["FAIL"] else "new"] += 1
        study.add(state="WAITING", params=params, weights=shares)
        seen["WAITING"] |= both
    return counts


def select(index: DataFrame, weights: Mapping[str, float], k: int, exact_ties: bool = False) -> DataFrame:
    """``line_idx`` and ``_weighted_score`` of the k best lines of a score index, read from the columns with weights."""
    scored = weighted(index.select("line_idx", *weights), weights).select("line_idx", "_weighted_score")
    return (top_k_heap if exact_ties else top_k)(scored, "_weighted_score", k)


def run(study: Study, index: DataFrame, objective: Callable[..., float], n_trials: int, s: Settings, pool: DataFrame | None = None, out: str | None = None, keep: int = 1_000_000, validation: str | None = None, cache: bool = False) -> Trial | None:
    """Run n_trials: queued weights first, then proposals; returns the best trial.

    objective gets the selected records (of pool where given, else lines with scores) and the weights, and gives a loss;
    one with a true attribute ``wants_folder`` also gets the trial's folder. A failing objective marks its trial FAIL and
    ends the search. With out each trial has a folder ``trials/trial_<number>`` whose ``data`` holds the selection as
    train.jsonl, best first, and dataset_info.json, which names it and the validation file; best_weights.json
    and history.svg are written after each trial, and the folders of the oldest trials beyond keep are removed. The index is kept in memory
    between trials, and with cache the pool too; each trial is one Spark job over the weighted columns.
    """
    gamma = s.gamma or partial(good_trials, share=s.gamma_share, most=s.gamma_most)
    names = [f"z_{k}" for k in s.keys]
    held = [index.persist()] + ([pool.persist()] if cache and pool is not None else [])
    best, idle = None, 0
    try:
        for _ in range(n_trials):
            history = study.trials()
            waiting = next((t for t in history if t.state == "WAITING"), None)
            done = [(t.params, t.value) for t in history if t.state == "COMPLETE" and t.params]
            if waiting is None:
                from .tpe import suggest

                rng = np.random.default_rng([s.seed, len(history)])
                waiting = study.add(params=suggest(names, done, *s.span, rng, s.startup, gamma, s.candidates, s.joint))
            t = waiting
            t.state, t.start = "RUNNING", time.time()
            t.weights = dict(zip(s.keys, weights_of([t.params[n] for n in names], s.method, s.span), strict=True))
            study.put(t)
            try:
                chosen = select(index, t.weights, s.k, s.exact_ties)
                if pool is not None:
                    chosen = fetch(pool, chosen).join(F.broadcast(chosen), "line_idx")  # k rows
                folder = trial_folder(out, t.number) if out else None
                if folder:
                    write_selection(chosen, folder / "data", validation)
                t.value = float(objective(chosen, t.weights, folder) if getattr(objective, "wants_folder", False) else objective(chosen, t.weights))
                t.state = "COMPLETE"
            except Exception:
                t.state = "FAIL"
                raise
            finally:
                t.complete = time.time()
                study.put(t)
            if out:
                top = study.best()
                save_best_weights(f"{out}/best_weights.json", study.name, top.value, top.weights, top.number, sum(x.state == "COMPLETE" for x in study.trials()), s.method, s.span)
                done = [(x.number, x.value) for x in study.trials() if x.state == "COMPLETE" and x.value is not None]
                Path(out, "history.svg").write_text(history_plot([(n, v, min(w for _, w in done[: i + 1])) for i, (n, v) in enumerate(done)]))
                clean(out, keep)
            if best is None or t.value < best - s.delta:
                best, idle = t.value, 0
            else:
                idle += 1
            if s.patience and idle >= s.patience:
                break
    finally:
        for x in held:
            x.unpersist()
    return study.best()


def trial_folder(out: str, number: int) -> Path:
    path = Path(out) / "trials" / f"trial_{number:05d}"
    path.mkdir(parents=True, exist_ok=True)
    return path


def write_selection(chosen: DataFrame, folder: Path, validation: str | None = None) -> Path:
    """train.jsonl with the chosen records, best first, and the manifest beside it. The k records pass through the driver one by one.

    A record is its line as read with ``_weighted_score`` added; without lines, its columns.
    """
    folder.mkdir(parents=True, exist_ok=True)
    rows = chosen
    if "raw" in chosen.columns:
        fields = F.coalesce(put(F.col("fields"), {"_weighted_score": number_text(F.col("score"))}), F.col("fields"))
        known = chosen.select("line_idx", "_weighted_score")
        lines = records(chosen.select("line_idx", "raw")).join(F.broadcast(known.withColumnRenamed("_weighted_score", "score")), "line_idx")
        rows = lines.select("line_idx", "score", rewritten(fields, F.col("raw")).alias("value"))
    else:
        rows = chosen.select("line_idx", F.col("_weighted_score").alias("score"), F.to_json(F.struct(*chosen.columns), {"ignoreNullFields": "false"}).alias("value"))
    path = folder / "train.jsonl"
    with path.open("w", encoding="utf-8") as file:
        for r in rows.orderBy(F.desc("score"), "line_idx").select("value").toLocalIterator():
            file.write(r["value"] + "\n")
    write_manifest(str(folder), "train", "train.jsonl")
    if validation:
        write_manifest(str(folder), "validation", str(Path(validation).absolute()))
    return path


class CommandObjective:
    """A training command as objective: run in a shell with {data}, {output} and {folder} filled in, it leaves a trainer_state.json below output.

    The loss is the last eval_loss there. A command that fails is tried again, `retries` times; its output is
    emptied before each try and appended to train.log in the trial's folder. Afterwards only the state files are kept, and the
    training data goes unless keep_data.
    """

    wants_folder = True

    def __init__(self, spark: SparkSession, command: str, retries: int = 2, keep_data: bool = False):
        self.spark, self.command, self.retries, self.keep_data = spark, command, retries, keep_data

    def __call__(self, chosen: DataFrame, weights: Mapping[str, float], folder: Path) -> float:
        data, output = folder / "data", folder / "output"
        line = self.command.format(data=shlex.quote(str(data)), output=shlex.quote(str(output)), folder=shlex.quote(str(folder)))
        for left in range(self.retries, -1, -1):
            shutil.rmtree(output, ignore_errors=True)
            output.mkdir(parents=True)
            with (folder / "train.log").open("a") as log:
                code = subprocess.run(line, shell=True, stdout=log, stderr=subprocess.STDOUT, check=False).returncode
            if not code:
                break
            if not left:
                raise RuntimeError(f"the command failed with code {code}; see {folder / 'train.log'}")
        found = sorted(output.rglob("trainer_state.json"), key=lambda p: p.stat().st_mtime)
        loss = last_eval_loss(self.spark, str(found[-1])) if found else None
        if loss is None:
            raise RuntimeError(f"no eval_loss below {output}")
        for path in sorted(output.rglob("*"), reverse=True):
            if path.is_file() and path.name != "trainer_state.json":
                path.unlink()
            elif path.is_dir() and not any(path.iterdir()):
                path.rmdir()
        if not self.keep_data:
            shutil.rmtree(data, ignore_errors=True)
        return loss


def command_objective(spark: SparkSession, config) -> CommandObjective:
    """For ``search --objective scoresieve.plans.search:command_objective``: the command is the setting train_command."""
    command = config.ignored.get("train_command")
    if not command:
        raise ValueError("set train_command in the configuration")
    return CommandObjective(spark, str(command), int(config.ignored.get("train_retries", 2)))


def clean(out: str, keep: int) -> int:
    """Remove the folders of the oldest trials beyond keep; returns how many."""
    found = sorted(Path(out, "trials").glob("trial_*")) if Path(out, "trials").is_dir() else []
    for path in found[: max(0, len(found) - keep)]:
        shutil.rmtree(path, ignore_errors=True)
    return max(0, len(found) - keep)


def logistic_objective(validation: DataFrame, features: Sequence[str], label: str) -> Callable[[DataFrame, Mapping[str, float]], float]:
    """A small proxy: log loss on validation of a logistic regression trained on the selection."""

    def loss(selected: DataFrame, weights: Mapping[str, float]) -> float:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        assemble = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
        train = assemble.transform(selected)
        if train.select(label).distinct().count() < 2:
            warnings.warn("the selection has one class only", stacklevel=2)
            return 50.0
        model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20).fit(train)
        p = vector_to_array(F.col("probability"))
        right = F.greatest(F.when(F.col(label) == 1, p[1]).otherwise(p[0]), F.lit(1e-12))
        return float(model.transform(assemble.transform(validation)).agg(F.avg(-F.ln(right))).first()[0])

    return loss
