"""Configuration: a YAML file, whose keys are checked, over defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

from keysift.operators.allow import Allowlist
from keysift.operators.detect import Options
from keysift.plans.catalogue import Rule, parse_rule

UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
FILES = (".keysift.yml", ".keysift.yaml")


def parse_size(raw: str) -> int:
    """Bytes from a number with an optional unit of 1024s."""
    if not (m := re.fullmatch(r"\s*(\d+)\s*([KMG]?B?)\s*", raw.upper())) or m[2] in ("K", "M", "G"):
        raise ValueError(f"size {raw!r} can't be read")
    return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class Config:
    max_file_size: int = 1 << 20
    fail_on: str = "low"
    min_confidence: str = "low"
    entropy: Options = Options()
    allowlist: Allowlist = Allowlist()
    extra_rules: tuple[Rule, ...] = ()
    baseline: str | None = None


def _known(given: dict, names: set[str], where: str) -> dict:
    if extra := set(given) - names:
        raise ValueError(f"{where}: unknown key {', '.join(sorted(extra))}")
    return given


def load(folder: str = ".", path: str | None = None) -> Config:
    """From ``path``, which must exist, or the first of FILES below ``folder``, or defaults."""
    import yaml

    found = Path(path) if path else next((p for n in FILES if (p := Path(folder, n)).exists()), None)
    if found is None:
        return Config()
    given = yaml.safe_load(found.read_text()) or {}
    _known(given, {"version", "concurrency", *(f.name for f in fields(Config))}, str(found))
    entropy = _known(given.get("entropy") or {}, {"enabled", "contextual", "min_length", "base64_threshold", "hex_threshold"}, "entropy")
    allow = _known(given.get("allowlist") or {}, {f.name for f in fields(Allowlist)}, "allowlist")
    size = given.get("max_file_size", 1 << 20)
    return Config(
        max_file_size=parse_size(size) if isinstance(size, str) else int(size), fail_on=given.get("fail_on", "low"), min_confidence=given.get("min_confidence", "low"),
        entropy=Options(entropy.get("enabled", True), entropy.get("contextual", True), entropy.get("min_length", 20), entropy.get("base64_threshold", 4.5), entropy.get("hex_threshold", 3.0)),
        allowlist=Allowlist(**{k: tuple(v or ()) for k, v in allow.items()}), extra_rules=tuple(parse_rule(r) for r in given.get("extra_rules") or ()), baseline=given.get("baseline"),
    )


def replace_size(config: Config, raw: str) -> Config:
    return replace(config, max_file_size=parse_size(raw))
