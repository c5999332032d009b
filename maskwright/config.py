"""Settings: which types are masked, consent phrases and custom patterns, with stepwise migration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import dialect
from .patterns import CONSENT_PHRASES

VERSION = 5
OFF_BY_DEFAULT = ("name_text",)
CUSTOM_PATTERN_BYTES = 500
COMMENT_GROUPS = {"comment": True, "review": True, "note": False, "other": True}
UNSAFE_REPLACEMENT = "<>\"'`"


@dataclass(frozen=True)
class CustomPattern:
    label: str
    pattern: str
    replacement: str = "***"
    enabled: bool = True

    @property
    def safe_replacement(self) -> str:
        """The replacement without characters that open tags or end attributes; ``***`` if nothing is left."""
        return self.replacement.translate(dict.fromkeys(map(ord, UNSAFE_REPLACEMENT))) or "***"

    @property
    def java(self) -> str | None:
        """The pattern as Spark runs it, or None where it has no such form."""
        return dialect.translated(self.pattern)

    @property
    def overruns(self) -> tuple[str, ...]:
        return dialect.overruns(self.pattern)

    @property
    def valid(self) -> bool:
        """Whether it is on, not too long, and compiles in the engine that runs it; needs a session."""
        if not self.enabled or not self.pattern or len(self.pattern.encode()) > CUSTOM_PATTERN_BYTES:
            return False
        return self.java is not None and dialect.compiles(self.java)


@dataclass(frozen=True)
class Settings:
    """``masks`` says of a type whether it is masked; types that it lacks are, but for those off by default."""

    masks: dict[str, bool] = field(default_factory=dict)
    consent_phrases: tuple[str, ...] = CONSENT_PHRASES
    custom_patterns: tuple[CustomPattern, ...] = ()
    strip_location: bool = True
    strip_identity: bool = True
    comment_groups: dict[str, bool] = field(default_factory=lambda: dict(COMMENT_GROUPS))

    def masked(self, kind: str | None) -> bool:
        return kind is not None and self.masks.get(kind, kind not in OFF_BY_DEFAULT)

    @property
    def customs(self) -> list[CustomPattern]:
        return [c for c in self.custom_patterns if c.valid]

    def with_masks(self, **masks: bool) -> Settings:
        return replace(self, masks=self.masks | masks)


#: What each version added, and whether it is on where nothing was chosen.
ADDED = {
    2: {"mask_hosting": 1, "mask_ip": 1, "mask_dob": 1, "mask_bank": 1, "mask_name_text": 0},
    3: {"comment_type_comment": 1, "comment_type_review": 1, "comment_type_note": 0, "comment_type_other": 1, "comment_ip": "keep"},
    4: {"mask_contact": 1, "mask_id_doc": 1},
    5: {"image_strip_location": 1, "image_strip_identity": 1},
}


def migrate(raw: dict) -> dict:
    """Stored settings in the current version: explicit choices stay, what later versions added gets its default.

    Empty settings stay empty. Nested ``integrations`` become flat keys; version 1's ``mask_hosting_id`` is
    ``mask_hosting`` since.
    """
    if not raw:
        return {}
    out = {k: v for k, v in raw.items() if k != "integrations"}
    nested = raw.get("integrations")
    for name, on in nested.items() if isinstance(nested, dict) else ():
        out.setdefault(f"integration_{name}", int(bool(on)))
    version = int(out.get("settings_version", 1))
    if version < 2 and (old := out.pop("mask_hosting_id", None)) is not None:
        out.setdefault("mask_hosting", int(bool(old)))
    for step, added in ADDED.items():
        if version < step:
            out = added | out
    out["settings_version"] = max(version, VERSION)
    return out


def load(raw: dict) -> Settings:
    """Settings from a stored flat map. A missing list of phrases means the default ones, an empty list none."""
    raw = migrate(raw)
    phrases = raw.get("consent_phrases")
    if phrases is None:
        kept = CONSENT_PHRASES
    else:
        kept = tuple(p["phrase"] for p in phrases if isinstance(p, dict) and p.get("enabled") and p.get("phrase")) if isinstance(phrases, list) else ()
    customs = tuple(CustomPattern(c.get("label") or "Custom pattern", c.get("pattern", ""), c.get("replacement") or "***", bool(c.get("enabled"))) for c in raw.get("custom_patterns") or ())
    masks = {k[5:]: bool(v) for k, v in raw.items() if k.startswith("mask_")}
    groups = {g: bool(raw.get(f"comment_type_{g}", on)) for g, on in COMMENT_GROUPS.items()}
    return Settings(masks, kept, customs, bool(raw.get("image_strip_location", 1)), bool(raw.get("image_strip_identity", 1)), groups)
