"""Plans over the file table, for tests and registered queries: each file's code stands in the notes of a plan for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import quoted

_FULL = "**Verify:** run the tests\n**Grounding:** read {path}\n"
FRONTS = ["---\ntitle: plan\nformat_version: 2\n---\n", "", "---\nformat_version: two\n---\n", "---\nformat_version: 2\nowner: us\n---\n"]
PLANS = [
    "# Plan {id}\n## Research Notes\n{notes}\n### Files Verified\n- {path}\n## Design Decisions\nOne table holds all. No TBD is left.\n## Low-Level Design\n- `def load` [NEW] in step 1\n- `Repo.get` [EXISTING] src/core/f1.py:3\n## Steps\n### Step 1: Change\n**File:** `{path}`\n**Action:** Edit\n**Details:** Replace the import.\n```anchor\nimport os\n```\n```replace\nimport sys  # def load\n```\n**Depends on:** none\n" + _FULL + "### Step 2: Write\n**File:** NEW: src/core/new{id}.py\n**Action:** Write\n**Details:** Write the module.\n**Depends on:** Step 1\n" + _FULL,
    "# Plan {id}\n## Research notes\n{notes}\n## Design Decisions\nEither a cache or a table, TBD.\nNot TODO here. `FIXME` is code, \"TBC\" a quote.\n## Steps\n### Step 1: Change\n**File:** src/none/f{id}.py\n**Action:** Edit and test\n**Details:** You should probably change it as discussed and then check ???\n**Depends on:** Steps 2, 7, 7\n**Verify:** run\n### Step 2: More\n**File:** NEW: other/dir/new.py\n**File:** {path}.\n**Action:** Write\n**Details:** see above; decide at review\n**Depends on:** Step 1\n" + _FULL,
    "# Plan {id}\n{notes}\n## Low-Level Design\n- `class Loader` [NEW]\n- `Repo.get(id)` [EXISTING] returns a row\n- nothing here\n## Steps\n## Step 3\n**file:** `{path}`\n**Action:** Edit [target: capable]\n**Details:** First read it, then change it. Option A is fine or not.\n**Depends On:** 3\n## Step 3: again\n**Details:** maybe around line 12, I think\n",
    "# Plan {id}\n## Research Notes\n### Files Verified\n### Step 1: Anchors\n**File:** {path}\n**Action:** edit\n**Details:** do it\n```anchor\n\n```\n```replace\nx\n```\n" + _FULL + "### Step 2: Twice\n**File:** {path}\n**Action:** Edit\n**Details:** if x then y else z\n```anchor\nreturn\n```\n```anchor\na\n```\n```replace\nx\n```\n**Depends on:** n/a\n" + _FULL + "### Step 3: Unique\n**File:** {path}\n**Action:** Edit\n**Details:** once\n```anchor\nreturn\n```\n```replace\nx\n```\n**Depends on:** Step 2\n" + _FULL + "{notes}",
    "no plan at all\n{notes}",
]
LAYERED = [
    "# Plan {id}\n## Research Notes\nread {path}\n## Epic Layer\none goal\n## Story Layer\n### Story 1 - Load\n**As** a user\n**I want** a table\n**So that** rows stay\n**Acceptance Criteria:** rows are equal\n##### 1.1 - Write\n**File:** {path}\n**Action:** Edit\n**Details:** write it\n**Depends on:** none\n" + _FULL,
    "# Plan {id}\n## Research notes\n{notes}\n## Epic  layer\n## Story Layer\n### story a.1 - Load\n**As** a user\n**I want** it, maybe\n##### 1.1 Write\n**File:** {path}\n**Depends on** 1\n##### 1.2 More\n**Action:** Edit\n### Story b-2\n**Acceptance criteria**\n",
    "# Plan {id}\n{notes}\n### Story 1\nIt should probably work, TBD.\n#### 1.1\nno subtask\n##### 1.1\n",
    "no plan\n{notes}",
]


def plans(files: DataFrame, texts: list[str] = PLANS) -> DataFrame:
    """plan_id, text."""
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("file_id") % len(items)).cast("int") + 1)
    text = F.concat(pick(FRONTS), pick(texts))
    for what, by in (("{path}", F.col("path")), ("{id}", F.col("file_id").cast("string")), ("{notes}", F.col("code"))):
        text = F.replace(text, F.lit(what), by)
    return files.select(F.col("file_id").alias("plan_id"), text.alias("text"))


def plans_sql(texts: list[str] = PLANS) -> str:
    """The same table for DuckDB, over `files`."""
    pick = lambda items: f"[{', '.join(map(quoted, items))}][file_id % {len(items)} + 1]"
    return f"plans AS (SELECT file_id AS plan_id, replace(replace(replace({pick(FRONTS)} || {pick(texts)}, '{{path}}', path), '{{id}}', file_id::VARCHAR), '{{notes}}', code) AS text FROM files)"


PLANS_SQL = plans_sql()
