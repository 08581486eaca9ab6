"""Rules, policies and settings from small local files, read and checked by the driver."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schemas import METRICS, REQUIRED_CONFIG, RULES, SEVERITIES


class ConfigError(ValueError):
    """A file that doesn't hold what it should; nothing of it is used."""


def _yaml(path: str):
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e


def read_rules(path: str) -> list[dict]:
    """The rules of a file, each checked for its type's keys and values."""
    data = _yaml(path)
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise ConfigError(f"{path} needs a list under 'rules'")
    for k, rule in enumerate(data["rules"]):
        at = f"{path}, rule {k}"
        if not isinstance(rule, dict) or (lacks := {"id", "type", "description", "severity"} - rule.keys()):
            raise ConfigError(f"{at} lacks {sorted(lacks) if isinstance(rule, dict) else 'its fields'}")
        if rule["type"] not in REQUIRED_CONFIG or rule["severity"] not in SEVERITIES:
            raise ConfigError(f"{at} has an unknown type or severity")
        config = rule.setdefault("config", {})
        if not isinstance(config, dict) or (lacks := set(REQUIRED_CONFIG[rule["type"]]) - config.keys()):
            raise ConfigError(f"{at} lacks {sorted(lacks) if isinstance(config, dict) else 'its config'}")
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        wrong = {
            "metric_threshold": lambda c: c["metric"] not in METRICS or not number(c["threshold"]),
            "cycle_detection": lambda c: c["scope"] not in ("cross_repo", "intra_repo"),
            "impact_threshold": lambda c: not isinstance(c["max_impact"], int) or isinstance(c["max_impact"], bool) or c["max_impact"] < 0,
        }.get(rule["type"])
        if wrong and wrong(config):
            raise ConfigError(f"{at} has a value that doesn't fit its type")
    return data["rules"]


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["id"], r["type"], r["description"], r["severity"], {k: str(v) for k, v in r["config"].items()}) for r in rules], RULES)


def read_policies(path: str) -> list[dict]:
    """name, allow, deny and require_review_when of each policy."""
    data = _yaml(path)
    if not isinstance(data, dict) or not isinstance(data.get("policies"), list):
        raise ConfigError(f"{path} needs a list under 'policies'")
    out = []
    for k, p in enumerate(data["policies"]):
        if not isinstance(p, dict) or "name" not in p:
            raise ConfigError(f"{path}, policy {k} lacks its name")
        out.append({"name": p["name"], "allow": list(p.get("allow") or []), "deny": list(p.get("deny") or []), "require_review_when": list(p.get("require_review_when") or [])})
    return out


@dataclass(frozen=True)
class Settings:
    """Defaults of indexing, retrieval and watching; unknown keys of a file are left out."""

    excluded: tuple[str, ...] = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", "*.min.js")
    max_file_size_kb: int = 500
    budget: int = 8000
    beam_width: int = 3
    hybrid_alpha: float = 0.7
    half_life_turns: float = 5.0
    debounce_ms: int = 1000
    max_batch_ms: int = 2000
    unknown: tuple[str, ...] = field(default=())


def read_settings(path: str) -> Settings:
    """The settings of a TOML file; keys that are unknown are left out, with a warning."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    flat = {k: v for section in data.values() if isinstance(section, dict) for k, v in section.items()}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in Settings.__dataclass_fields__ and k != "unknown"}
    unknown = tuple(sorted(set(flat) - set(known)))
    if unknown:
        warnings.warn(f"{path} has unknown keys: {', '.join(unknown)}", stacklevel=2)
    return Settings(**known, unknown=unknown)


def read_repositories(path: str) -> list[dict]:
    """name and path of each [[repos]] entry; relative paths are below the file's folder."""
    with open(path, "rb") as f:
        repos = tomllib.load(f).get("repos", [])
    root = os.path.dirname(os.path.abspath(path))
    return [{"name": r["name"], "path": os.path.normpath(os.path.join(root, r["path"])), "language": r.get("language_hint")} for r in repos]
