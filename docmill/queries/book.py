"""All registered queries."""

from __future__ import annotations

from docmill.queries import common, corpus, costs, masking, pages, records, service, tries  # noqa: F401


def queries() -> dict[str, common.Query]:
    return dict(common.QUERIES)


def oracles() -> dict[str, str]:
    return dict(common.ORACLES)
