"""Every parameter of the recruitment pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# The job sites whose postings are kept.
ALLOWED_SOURCES = ("智联招聘", "前程无忧", "拉勾网", "BOSS直聘", "58同城", "猎聘网", "看准网", "百姓网", "猎聘", "赶集网", "BOSS")
# Fixed value: the title of part-time postings.
PART_TIME = "兼职"
# What the classification service is asked.
TITLE_PROMPT = 'The most likely Standard Occupational Classification title and code the occupation fall into: "%s", only show the SOC code.'
CHECK_PROMPT = (
    "Based on this job description (in Chinese): '%s' Is this Standard Occupational Classification code: '%s' a reasonable"
    " classification (at broad group level)? Only tell me yes or no."
)
# Fixed value: the model that is asked.
SERVICE_MODEL = "gpt-3.5-turbo-0301"
#: What a failed call answers.
NO_ANSWER = "N/A"


@dataclass(frozen=True)
class Config:
    sentinels: tuple[str, ...] = (r"\N", "")
    allowed_sources: tuple[str, ...] = ALLOWED_SOURCES
    part_time_title: str = PART_TIME
    part_time_match: str = "exact"  # or "contains"
    dedup_keys: tuple[str, ...] = ("company_id", "title", "city", "date")
    dedup_scope: str = "shard"  # or "global"
    census_top: int = 20
    min_title_count: int = 6
    title_shards: int = 300
    title_concurrency: int = 30
    check_concurrency: int = 20
    min_group: int = 101
    check_cap: int = 3000
    rest_cap: int = 5000
    pool_excludes: str = "passed"  # or "checked"
    accepted_answer: str = "Yes"
    normalise_answer: bool = False
    excluded_code_prefix: str = "55"
    weight_checked: float = 1.0
    weight_other: float = 0.5
    title_repeats: int = 2
    max_length: int = 512
    seed: int = 42
    select_by: str = "loss"  # or "accuracy"
    grid: dict[str, tuple[float, ...]] = field(default_factory=lambda: {"regParam": (0.001, 0.01, 0.1), "elasticNetParam": (0.0, 0.25, 0.5)})
