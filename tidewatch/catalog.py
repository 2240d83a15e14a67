"""Catalogs as data: enumerations, keyword groups, sources and regions; a loader that checks them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

# Codes that stored rows carry.
CATEGORIES = ("veterans", "disabled", "svo")
EVENT_TYPES = ("new_document", "amendment", "repeal", "entry_into_force", "review")
PRIORITIES = ("high", "medium", "low")
STATUSES = ("new", "in_progress", "postponed", "rejected", "sent_to_agent", "completed")
REJECTION_REASONS = ("not_target_category", "duplicate", "not_npa", "other")
REGIONS = ("rf", "moscow", "undefined")
ACCESS = ("direct", "ru_proxy", "unsupported")
#: Event types in the order in which their markers are tried.
EVENT_ORDER = ("repeal", "entry_into_force", "amendment", "new_document")
TRANSITIONS = (
    ("new", "in_progress"), ("new", "rejected"), ("new", "postponed"),
    ("in_progress", "postponed"), ("in_progress", "rejected"), ("in_progress", "sent_to_agent"),
    ("postponed", "in_progress"), ("postponed", "rejected"),
    ("sent_to_agent", "completed"),
    ("rejected", "new"),
)


class CatalogError(Exception):
    """A catalog is missing or holds a code that no enumeration knows."""


@dataclass(frozen=True)
class Source:
    domain: str
    access: str = "direct"
    url: str | None = None
    note: str | None = None


@dataclass(frozen=True)
class Catalog:
    """Everything that classification needs; keyword groups keep their order. ``further`` sources are known domains only."""

    situations: dict[str, tuple[str, ...]]
    topic: tuple[str, ...]
    markers: tuple[str, ...]
    high: tuple[str, ...]
    events: dict[str, tuple[str, ...]]
    federal: tuple[Source, ...] = ()
    other: tuple[Source, ...] = ()
    further: tuple[Source, ...] = ()
    regions: tuple[tuple[str, tuple[Source, ...]], ...] = ()
    names: dict[str, str] = field(default_factory=dict)

    def domains(self) -> list[str]:
        """All known domains, whatever their access; sorted."""
        regional = [s for _, sources in self.regions for s in sources]
        return sorted({s.domain for s in (*self.federal, *self.other, *self.further, *regional)})


def _read(path: Path):
    import yaml

    if not path.exists():
        raise CatalogError(f"no catalog at {path}")
    return yaml.safe_load(path.read_text(encoding="utf-8"))


def _checked(code: str, known: tuple[str, ...], where: str) -> str:
    if code not in known:
        raise CatalogError(f"{where}: {code!r} is none of {', '.join(known)}")
    return code


def load(folder: str | Path) -> Catalog:
    """Catalogs from life_situations, keywords, sources and regions (.yaml) in a folder; empty files are empty catalogs."""
    folder = Path(folder)
    situations = _read(folder / "life_situations.yaml") or []
    words = _read(folder / "keywords.yaml") or {}
    sources = _read(folder / "sources.yaml") or {}
    regions = _read(folder / "regions.yaml") or []
    made = lambda entries: tuple(Source(**x) for x in entries or ())
    return Catalog(
        situations={_checked(x["id"], CATEGORIES, "life_situations.yaml"): tuple(x["keywords"]) for x in situations},
        topic=tuple(words.get("topic_block", ())),
        markers=tuple(words.get("document_markers", ())),
        high=tuple(words.get("priority_high_words", ())),
        events={_checked(k, EVENT_TYPES, "keywords.yaml"): tuple(v) for k, v in (words.get("event_type_markers") or {}).items()},
        federal=made(sources.get("federal")),
        other=made(sources.get("other")),
        further=tuple(s for group, entries in sources.items() if group not in ("federal", "other") for s in made(entries)),
        regions=tuple((_checked(x["code"], REGIONS, "regions.yaml"), made(x.get("sources"))) for x in regions),
        names={x["id"]: x["name"] for x in situations},
    )


# The Russian vocabulary and sources of the monitored publications.
RUSSIAN = Catalog(
    situations={
        "veterans": ("ветеран боевых действий", "ВБД", "ветеран СВО"),
        "disabled": ("инвалид", "ребёнок-инвалид", "лицо с ограниченными возможностями", "инвалид с детства", "инвалид по зрению"),
        "svo": ("участник СВО", "мобилизованный", "контрактник", "доброволец", "члены семей участников СВО", "дети участников СВО"),
    },
    topic=("мера поддержки", "выплата", "льгота", "пособие", "компенсация", "субсидия", "набор социальных услуг", "социальная поддержка", "социальные услуги", "социальная выплата"),
    markers=("постановление", "указ", "закон", "приказ", "распоряжение"),
    high=("новый", "изменение", "отмена", "утратил силу", "индексация", "повышение"),
    events={
        "repeal": ("отмена", "отменён", "отменен", "утратил силу", "утратила силу"),
        "entry_into_force": ("вступил в силу", "вступает в силу", "вступила в силу"),
        "amendment": ("внесены изменения", "внесение изменений", "изменение"),
        "new_document": ("принят", "принята", "утверждён", "утвержден", "утверждена", "подписан", "подписана"),
    },
    federal=(
        Source("publication.pravo.gov.ru", "ru_proxy", "http://publication.pravo.gov.ru/"),
        Source("kremlin.ru", "ru_proxy", "http://www.kremlin.ru/"),
        Source("government.ru", "ru_proxy", "https://government.ru/"),
        Source("sfr.gov.ru", "direct", "https://sfr.gov.ru/"),
        Source("mintrud.gov.ru", "direct", "https://mintrud.gov.ru/"),
    ),
    other=(
        Source("garant.ru", "direct", "https://rss.garant.ru/news/"),
        Source("consultant.ru", "direct", "https://www.consultant.ru/rss/hotdocs.xml"),
        Source("docs.cntd.ru", "unsupported", "https://docs.cntd.ru/comments"),
        Source("tass.ru", "direct", "https://tass.ru/rss/v2.xml"),
        Source("ria.ru", "direct", "https://ria.ru/export/rss2/index.xml"),
        Source("rg.ru", "direct", "https://rg.ru/xml/index.xml"),
    ),
    regions=(
        ("rf", ()),
        ("moscow", (Source("mos.ru", "direct", "https://www.mos.ru/authority/documents/"), Source("msupport.dszn.ru"), Source("dszn.ru", "unsupported"))),
    ),
    names={"veterans": "Ветераны боевых действий", "disabled": "Люди с инвалидностью", "svo": "Участники СВО и члены их семей"},
)

# A vocabulary that occurs in the synthetic documents.
SYNTHETIC = Catalog(
    situations={"cat_a": ("license", "ertion"), "cat_b": ("enlich", "erkeit"), "cat_c": ("ciónas", "enheit")},
    topic=("that", "thing"),
    markers=("thtion", "attion"),
    high=("thin", "apache"),
    events={"repeal": ("license",), "entry_into_force": ("with the",), "amendment": ("antion", "ontion"), "new_document": ("thanea", "thanedble")},
    federal=tuple(Source(f"src{k}") for k in range(2, 7)),
    regions=(("moscow", (Source("src0"), Source("src1"))), ("rf", (Source("src1"),))),
)

# Labels of codes in rendered cards.
CATEGORY_LABELS = {"veterans": "ВБД", "disabled": "Инвалиды", "svo": "СВО"}
STATUS_LABELS = {"new": "Новый", "in_progress": "В работе", "postponed": "Отложен", "rejected": "Отклонён", "sent_to_agent": "Передан агенту", "completed": "Завершён"}
EVENT_LABELS = {"new_document": "Новый документ", "amendment": "Изменение", "repeal": "Отмена", "entry_into_force": "Вступление в силу", "review": "Обзор"}
PRIORITY_LABELS = {"high": "🔴 Высокий", "medium": "🟡 Средний", "low": "🟢 Низкий"}
REGION_LABELS = {"rf": "РФ", "moscow": "Москва", "undefined": "Не определён"}
REASON_LABELS = {"r_not_target": "Не относится к целевым категориям", "r_dup": "Дубликат", "r_not_npa": "Не является НПА", "r_other": "Другое"}
