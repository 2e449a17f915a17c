"""A report on what this environment can do; no session is started and nothing is changed."""

from __future__ import annotations

import importlib.metadata
import os
import platform
import re
import shutil
from collections.abc import Iterable

#: Worse states come later; what needs several things is as good as the worst of them.
STATES = ("READY", "PARTIAL", "NOT AVAILABLE", "INCOMPATIBLE")
#: The least version of each package that is used, and what each capability needs.
LEAST = {"python": (3, 10), "pyspark": (3, 5), "numpy": (1, 23), "pandas": (2, 0), "pyarrow": (11, 0), "mlflow": (2, 12), "optuna": (3, 0), "lightgbm": (4, 0), "matplotlib": (3, 6)}
NEEDS = {
    "spark": ("python", "pyspark", "numpy", "java"),
    "pandas": ("python", "pandas", "numpy", "pyarrow"),
    "folder storage": ("folder",),
    "mlflow storage": ("mlflow",),
    "lightgbm models": ("lightgbm",),
    "adaptive search": ("optuna",),
    "figures": ("matplotlib",),
}
BACKENDS, DESTINATIONS = ("spark", "pandas"), {"folder": "folder storage", "mlflow": "mlflow storage", "none": None}
MODELS = {"logistic_regression": None, "random_forest": None, "gradient_boosting": None, "lightgbm": "lightgbm models"}


def version_state(version: str | None, least: tuple[int, ...]) -> str:
    """READY from the least version on, INCOMPATIBLE below it; PARTIAL for a form that is no plain release."""
    if version is None:
        return "NOT AVAILABLE"
    plain = re.match(r"^[0-9]+(\.[0-9]+)*(\+[\w.]+)?$", version)
    if not plain:
        return "PARTIAL"
    return "READY" if tuple(map(int, version.split("+")[0].split("."))) >= least else "INCOMPATIBLE"


def worst(states: Iterable[str]) -> str:
    return max(states, key=STATES.index, default="READY")


def observed() -> dict[str, dict]:
    """Version and error of each part; of an error only the type is kept, so that no path or secret is shown."""

    def guarded(look) -> dict:
        try:
            return {"version": look(), "error": None}
        except Exception as error:
            return {"version": None, "error": type(error).__name__}

    parts = {n: guarded(lambda n=n: importlib.metadata.version(n)) for n in LEAST if n != "python"}
    parts["python"] = guarded(platform.python_version)
    home = os.environ.get("JAVA_HOME")
    parts["java"] = guarded(lambda: "found" if shutil.which("java") or home and os.path.exists(os.path.join(home, "bin", "java")) else None)
    return parts


def _session() -> dict:
    """What is known of a running session: its version and whether it gives access to a JVM. None is made."""
    try:
        from pyspark.sql import SparkSession

        active = SparkSession.getActiveSession()
        if active is None:
            return {"running": False, "version": None, "jvm": None, "error": None}
        return {"running": True, "version": active.version, "jvm": getattr(active, "_jvm", None) is not None, "error": None}
    except Exception as error:
        return {"running": False, "version": None, "jvm": None, "error": type(error).__name__}


def judged(parts: dict[str, dict], session: dict) -> tuple[dict[str, str], dict[str, str]]:
    """The state of each part, and of each capability: as good as the worst part that it needs."""
    states = {n: version_state(p["version"], LEAST[n]) for n, p in parts.items() if n in LEAST}
    states = {n: "PARTIAL" if parts[n]["error"] not in (None, "PackageNotFoundError") else s for n, s in states.items()}
    states |= {"java": "READY" if parts["java"]["version"] else "NOT AVAILABLE", "folder": "READY"}
    found = {name: worst(states[n] for n in needs) for name, needs in NEEDS.items()}
    minor = lambda v: str(v).split(".")[:2]
    if session["error"] or session["running"] and (not session["jvm"] or minor(session["version"]) != minor(parts["pyspark"]["version"])):
        found["spark"] = worst([found["spark"], "PARTIAL"])
    return states, found


def doctor(*, backend: str | None = None, model: str | None = None, save_model_to: str | None = None, verbose: bool = True) -> dict:
    """What is installed, the state of each capability, and whether a wanted operation can run; printed if ``verbose``.

    ``backend`` with ``model`` and ``save_model_to`` names an operation; without it, the first backend that is
    ready is recommended. READY says that the inspected needs are there, not that a job has been tried.
    """
    if backend not in (None, *BACKENDS) or model not in (None, *MODELS) or save_model_to not in (None, *DESTINATIONS):
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}, model of {', '.join(MODELS)}, save_model_to of {', '.join(DESTINATIONS)}")
    if backend is None and (model or save_model_to):
        raise ValueError("a model or a destination needs a backend")
    parts, session = observed(), _session()
    states, capabilities = judged(parts, session)
    recommended = backend or next((b for b in BACKENDS if capabilities[b] == "READY"), None)
    wanted = [x for x in (backend or recommended, MODELS.get(model), DESTINATIONS.get(save_model_to)) if x] or list(BACKENDS)
    blocking = {w: capabilities[w] for w in wanted if capabilities[w] != "READY"}
    advice = [f"{w}: {state.lower()}; needs {', '.join(NEEDS[w])}" for w, state in blocking.items()]
    report = {"parts": {n: p | {"state": states[n]} for n, p in parts.items()}, "session": session, "capabilities": capabilities, "recommended_backend": recommended, "result": worst(blocking.values()), "blocking": blocking, "advice": advice}
    if verbose:
        for name, state in capabilities.items():
            print(f"{state:14} {name}")
        print("\n".join([f"Result: {report['result']}", *advice]))
    return report
