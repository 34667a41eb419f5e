"""Plans of tasks on the driver: order, enabled sections, values of configurations, and checks before a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.sources import files


def ordered(dependencies: Mapping[str, Iterable[str]], requested: Iterable[str]) -> list[str]:
    """The requested tasks after all that they depend on, in the order of the request. Unknown names and cycles are errors."""
    done: dict[str, None] = {}
    for wanted in requested:
        path: list[tuple[str, list[str]]] = [("", [wanted])]
        open_: set[str] = set()
        while path:
            name, rest = path[-1]
            if not rest:
                path.pop()
                open_.discard(name)
                if name:
                    done[name] = None
                continue
            task = rest.pop(0)
            if task in open_:
                raise ValueError(f"cycle at task {task}")
            if task in done:
                continue
            if task not in dependencies:
                raise ValueError(f"unknown task {task}")
            open_.add(task)
            path.append((task, list(dependencies[task])))
    return list(done)


def enabled(config: Mapping, section: str) -> bool:
    """A section that is there and not null is enabled unless it says otherwise."""
    found = config.get(section)
    return found is not None and bool(found.get("enabled", True))


def flat(config, path: str = "") -> list[tuple[str, object]]:
    """(dotted path, value) of the leaves of a configuration."""
    if isinstance(config, Mapping):
        return [x for k, v in config.items() for x in flat(v, f"{path}.{k}" if path else str(k))]
    if isinstance(config, (list, tuple)):
        return [x for i, v in enumerate(config) for x in flat(v, f"{path}[{i}]")]
    return [(path, config)]


def placeholders(config, mark: str = "/project/") -> list[str]:
    """Paths of the strings that hold a placeholder."""
    return [p for p, v in flat(config) if isinstance(v, str) and mark in v]


def image_size(value) -> list[int] | None:
    """Width and height of a size given as a number, text or sequence of one or two; None for anything else."""
    try:
        if isinstance(value, (list, tuple)):
            got = [int(float(x)) for x in value]
            return got * 2 if len(got) == 1 else got[:2] if len(got) >= 2 else None
        return None if value is None or isinstance(value, (bool, Mapping)) else [int(float(value))] * 2
    except (TypeError, ValueError):
        return None


def name_list(value) -> list[str]:
    """Class names of a list, or of a mapping in the order of its keys; nulls are left out."""
    if isinstance(value, Mapping):
        number = lambda k: (0, int(k), "") if str(k).lstrip("-").isdigit() else (1, 0, str(k))
        value = [value[k] for k in sorted(value, key=number)]
    return [str(x) for x in value or [] if x is not None]


def aliases(known: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Canonical name by each name and alias, in lower case."""
    return {x.lower(): name for name, more in known.items() for x in (name, *more)}


def task_key(name: str, labels: Mapping[str, str]) -> str | None:
    """The key that a name stands for: a key, else a label as it is, else a label in any case."""
    if name in labels:
        return name
    by = {v: k for k, v in labels.items()}
    return by.get(name) or {v.lower(): k for v, k in by.items()}.get(name.strip().lower())


def require(config: Mapping, keys: Iterable[str]) -> None:
    if missing := [k for k in keys if k not in config]:
        raise ValueError(f"missing keys: {missing}")


def positive(value, name: str) -> int:
    got = int(value)
    if got <= 0:
        raise ValueError(f"{name} must be positive, got {got}")
    return got


def ratio(value, name: str) -> float:
    got = float(value)
    if not 0 <= got <= 1:
        raise ValueError(f"{name} must be between 0 and 1, got {got}")
    return got


def unique_names(names) -> list[str]:
    if not isinstance(names, (list, tuple)) or not names or not all(isinstance(n, str) for n in names) or len(set(names)) < len(names):
        raise ValueError("class names are distinct strings in a list that isn't empty")
    return list(names)


def checked_ratios(ratios: Mapping[str, float], slack: float = 1e-6) -> dict[str, float]:
    """Ratios of a split, which must each be in range and add up to one."""
    got = {k: ratio(v, k) for k, v in ratios.items()}
    if abs(sum(got.values()) - 1) > slack:
        raise ValueError(f"ratios add up to {sum(got.values())}")
    return got


@dataclass(frozen=True)
class Issue:
    severity: str
    task: str
    message: str


def preflight(spark: SparkSession, tasks: Iterable[str], config: Mapping, there: Callable[[str], bool] | None = None) -> DataFrame:
    """severity, task, message of what would stop or spoil a run of ``tasks``.

    The class ids of all label files are read, not of a sample of them.
    """
    tasks = set(tasks)
    there = there or (lambda path: files.exists(spark, path))
    section = lambda *keys: _get(config, keys)
    train = section("yolo_training") or {}
    names, found = train.get("class_names") or [], []
    add = lambda severity, task, message: found.append(Issue(severity, task, message))
    folder = train.get("dataset_dir")
    if names and folder:
        top = files.label_classes(spark, f"{folder}/train/labels").agg(F.max(F.array_max("classes"))).first()[0]
        if top is not None and top >= len(names):
            add("ERROR", "yolo_train", f"class id {top} in the labels, but {len(names)} class names")
    if tasks & {"dataset_splitter", "yolo_train"}:
        for key in ("image_dir", "label_dir"):
            path = section("train_test_split", "input", key)
            if path and not there(path):
                add("ERROR", "dataset_splitter", f"{key} not found: {path}")
    if "yolo_train" in tasks:
        if not names:
            add("ERROR", "yolo_train", "no class names")
        model = train.get("model")
        if model and not there(model) and not there("models/" + model.rsplit("/", 1)[-1]):
            add("WARNING", "yolo_train", f"base weights not found: {model}")
    for task, key in (("color_inspection", "sam_checkpoint"), ("color_verification", "color_stats")):
        path = section(task, key)
        if task in tasks and path and not there(path):
            add("ERROR", task, f"{key} not found: {path}")
    if "deploy" in tasks:
        deploy = train.get("deploy") or {}
        target = deploy.get("inference_models_dir")
        if not deploy.get("enabled"):
            add("WARNING", "deploy", "deployment is off")
        elif not target:
            add("ERROR", "deploy", "no inference_models_dir")
        elif not there(target):
            add("WARNING", "deploy", f"target will be made: {target}")
        project, name = train.get("project"), train.get("name", "train")
        if "yolo_train" not in tasks and project and name and not there(f"{project}/{name}/weights/best.pt"):
            add("WARNING", "deploy", f"no trained weights in {project}/{name}")
    return spark.createDataFrame([(i.severity, i.task, i.message) for i in found], "severity string, task string, message string")


def _get(config, keys):
    for k in keys:
        config = config.get(k) if isinstance(config, Mapping) else None
    return config
