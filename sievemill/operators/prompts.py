"""Prompts (prompt_id, text): kind of task, language, flags, ambiguity, questions, ceremony. Columns of one row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain
from .entities import found

#: Signs of tasks, languages and topics, with weights.
TASKS = {
    "generation": [(r"\b(create|add|implement|build|make|generate|develop)\b", 2), (r"\bnew\s+(feature|component|function|class|service)\b", 3), (r"\b(feature|component|function|class|service)\b", 1)],
    "refactor": [(r"\brefactor\b", 5), (r"\b(improve|optimize|clean|reorganize|restructure)\b", 3), (r"\b(simplify|extract|split|merge|consolidate)\b", 2)],
    "debug": [(r"\b(fix|bug|error|issue|problem|broken)\b", 3), (r"\bnot working|failing\b", 3), (r"\b(debug|troubleshoot|investigate|diagnose)\b", 4)],
    "review": [(r"\breview\b", 4), (r"\b(check|audit|analyze|examine|inspect)\b", 2), (r"\b(code review|security review|performance review)\b", 5)],
    "documentation": [(r"\bdocument\b", 4), (r"\b(explain|comment|describe|readme)\b", 2), (r"\b(jsdoc|docstring|documentation|docs)\b", 4)],
    "test": [(r"\bunit\s+tests?\b", 5), (r"\bintegration\s+tests?\b", 5), (r"\btests?\b", 3), (r"\b(spec|coverage|testing)\b", 3), (r"\b(jest|pytest|mocha|vitest)\b", 4)],
    "planning": [
        (r"\b(create|make|write)\s+(a\s+)?plan\b", 5), (r"\bplan\s+(for|to|out)\b", 5), (r"\bplanning\b", 4), (r"\bimplementation\s+plan\b", 5), (r"\bdesign\s+(the\s+)?implementation\b", 4), (r"\barchitect\b", 3),
        (r"\bbreak\s*down\b", 3), (r"\bstrategy\s+for\b", 3), (r"\broadmap\b", 3), (r"\bsteps\s+to\b", 2), (r"\bhow\s+should\s+(i|we)\s+implement\b", 4),
    ],
}
LANGUAGES = {
    "typescript": [(r"\btypescript\b", 5), (r"\.tsx?$", 4), (r"\bts\b", 3), (r"\bangular\b", 3), (r"\bnext\.?js\b", 3)],
    "python": [(r"\bpython\b", 5), (r"\.py$", 4), (r"\bdjango\b", 3), (r"\bfastapi\b", 3), (r"\bflask\b", 3), (r"\blangchain\b", 3), (r"\blanggraph\b", 3)],
    "javascript": [(r"\bjavascript\b", 5), (r"\.jsx?$", 4), (r"\bjs\b", 3), (r"\bnode\b", 3), (r"\breact\b", 2), (r"\bvue\b", 2)],
    "rust": [(r"\brust\b", 5), (r"\.rs$", 4), (r"\bcargo\b", 3)],
    "go": [(r"\bgolang\b", 5), (r"\.go$", 4), (r"\bgo\b", 3)],
    "java": [(r"\bjava\b", 5), (r"\.java$", 4), (r"\bspring\b", 3), (r"\bmaven\b", 3)],
    "csharp": [(r"\bc#", 5), (r"\.net\b", 4), (r"\bcsharp\b", 5), (r"\.cs\b", 4), (r"\basp\.net\b", 3), (r"\blazor\b", 3)],
}
RAG = r"\brag\b|\bretrieval.augmented\b|\bvector\s*(store|db|database)\b|\bembedding[s]?\b|\bknowledge\s*graph\b|\bgraphrag\b|\bchunking\b|\bsimilarity.search\b|\bsemantic.search\b|\bretriever\b|\breranking\b|\bvector.index\b"
GRAPH = r"\bknowledge\s*graph\b|\bgraphrag\b|\bgraph\s*database\b|\bgraph\s*traversal\b|\bentity\s*relation\b|\bentity\s*extraction\b|\bontology\b|\bcypher\b|\bgremlin\b|\btriple\s*store\b|\brdf\b|\bsparql\b|\bproperty\s*graph\b"
RAG_FRAMEWORKS, GRAPH_FRAMEWORKS = r"\b(chromadb|pinecone|faiss|neo4j|weaviate|milvus|qdrant)\b", r"\b(neo4j|weaviate)\b"
FRAMEWORKS = {
    "react": [r"\breact\b", r"\.jsx", r"\.tsx", r"\bcomponent\b"],
    "next.js": [r"\bnext\.?js\b", r"\bapp router\b", r"\bpages router\b"],
    "vue": [r"\bvue\b", r"\.vue$", r"\bnuxt\b"],
    "fastapi": [r"\bfastapi\b", r"\bpydantic\b"],
    "django": [r"\bdjango\b"],
    "express": [r"\bexpress\b"],
    "prisma": [r"\bprisma\b"],
    "tailwind": [r"\btailwind\b", r"\btailwindcss\b"],
    "langchain": [r"\blangchain\b", r"\bcreate_agent\b", r"\bAgentExecutor\b"],
    "langgraph": [r"\blanggraph\b", r"\bStateGraph\b", r"\badd_conditional_edges\b"],
    "chromadb": [r"\bchroma(?:db)?\b", r"\bchroma_client\b", r"\bPersistentClient\b"],
    "pinecone": [r"\bpinecone\b"],
    "faiss": [r"\bfaiss\b", r"\bIndexFlat\b"],
    "neo4j": [r"\bneo4j\b", r"\bcypher\b", r"\bNeo4jVector\b"],
    "weaviate": [r"\bweaviate\b", r"\bWeaviateClient\b"],
    "milvus": [r"\bmilvus\b", r"\bMilvusClient\b", r"\bpymilvus\b"],
    "qdrant": [r"\bqdrant\b", r"\bQdrantClient\b"],
    "anthropic-sdk": [r"\bimport\s+anthropic\b", r"from\s+anthropic\s+import", r"\bclient\.messages\.create\b"],
    "openai-sdk": [r"\bimport\s+openai\b", r"from\s+openai\s+import", r"\bclient\.chat\.completions\b"],
    "vercel-ai": [r"from\s+['\"]ai['\"]", r"\bstreamText\b", r"\bgenerateText\b", r"\bgenerateObject\b"],
    "llamaindex": [r"\bllama[_-]?index\b", r"\bVectorStoreIndex\b", r"\bQueryEngine\b"],
    "autogen": [r"\bimport\s+autogen\b", r"\bConversableAgent\b", r"\bGroupChatManager\b"],
    "instructor": [r"\bimport\s+instructor\b", r"\binstructor\.from_\w+\b", r"\bresponse_model\b"],
    "pydantic-ai": [r"from\s+pydantic_ai\s+import", r"\bpydantic[_\-]ai\b", r"\bRunContext\b"],
    "haystack": [r"\bimport\s+haystack\b", r"from\s+haystack\s+import", r"\bPipeline\b.*\bComponent\b"],
    "openai-agents": [r"from\s+openai_agents\s+import", r"@function_tool\b", r"\bRunner\.run\b"],
    "mcp-server": [r"from\s+fastmcp\s+import", r"@mcp\.tool", r"@mcp\.resource", r"\bmcp\.run\b"],
    "aspnetcore": [r"\basp\.net\s*core\b", r"\bIActionResult\b", r"\bControllerBase\b", r"\bapp\.MapGet\b", r"\[ApiController\]"],
    "sqlalchemy": [r"\bsqlalchemy\b", r"\bDeclarativeBase\b", r"\bAsyncSession\b"],
    "axum": [r"\baxum\b", r"\bRouter::new\b", r"\bIntoResponse\b"],
    "zustand": [r"from\s+['\"]zustand['\"]", r"\bcreateStore\b", r"\bcreate\s*\(\s*\(set\b"],
    "tanstack-query": [r"@tanstack/react-query", r"\buseQuery\b", r"\bqueryKey\b", r"\bQueryClient\b"],
    "graphql": [r"\bgraphql\b", r"\btype\s+Query\s*\{", r"\btype\s+Mutation\s*\{", r"\bgql\b"],
    "opentelemetry": [r"\bopentelemetry\b", r"from\s+opentelemetry", r"\bTracerProvider\b", r"\btracer\.start"],
}
VAGUE, ASKED = ["something", "stuff", "thing", "it", "this", "that", "some"], ["something", "stuff", "thing", "it", "this", "that"]
CEREMONY, TASK_SCORE = ["micro", "light", "standard", "thorough"], {"generation": 2, "refactor": 2, "planning": 4, "documentation": 0}


def scores(text: Column, signs: dict) -> Column:
    """(score, at, name) of each name whose signs are in the text, best first; of equals the one named first. Each sign counts once."""
    each = [F.struct(sum((F.when(text.rlike(p), w).otherwise(0) for p, w in patterns), F.lit(0)).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(signs.items())]
    return F.reverse(F.array_sort(F.filter(F.array(*each), lambda s: s["score"] > 0)))


def frameworks(low: Column) -> Column:
    """The frameworks whose signs are in a lower-case text, in the order of the table."""
    return F.array_compact(F.array(*[F.when(low.rlike("(?i)" + "|".join(signs)), name) for name, signs in FRAMEWORKS.items()]))


def ambiguity(low: Column, words: Column, unknown: Column, no_language: Column) -> Column:
    """0 to 1: under five words 0.3, no known task 0.3, no language 0.2, each vague word 0.1."""
    part = lambda c, x: F.when(c, x).otherwise(0)
    tenths = part(words < 5, 3) + part(unknown, 3) + part(no_language, 2) + sum((part(low.rlike(rf"\b{w}\b"), 1) for w in VAGUE), F.lit(0))
    return F.least(tenths, F.lit(10)) / 10.0


def classify(prompts: DataFrame, security: str, ask_from: float = 0.6, least: str = "micro", unresolved: str | None = None) -> DataFrame:
    """prompt_id, task, others (scores of 4 and more, best first), language, frameworks, three flags, ambiguity, questions, ceremony.

    Ceremony: the task's score, one each for other tasks, for what the prompt names, for 200 and for 500 characters, and one for each of at most two frameworks; raised by the flags,
    by ambiguity and by plans, by one level where the column `unresolved` (errors that a session has left) is above 0; `least` at least."""
    low = plain(F.lower("text"))
    errors = F.lit(0) if unresolved is None else F.coalesce(F.col(unresolved), F.lit(0))
    rows = prompts.select("prompt_id", low.alias("low"), F.length("text").alias("n"), (F.size(found(F.col("text"))) > 0).alias("names"), errors.alias("errors"), F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), "")).alias("words"), scores(low, TASKS).alias("tasks"), F.get(scores(low, LANGUAGES), F.lit(0))["name"].alias("language"))
    rows = rows.select(
        "prompt_id", "low", "n", "names", "errors", "words", "language", F.coalesce(F.get("tasks", F.lit(0))["name"], F.lit("unknown")).alias("task"),
        F.transform(F.filter(F.slice("tasks", 2, len(TASKS)), lambda t: t["score"] >= 4), lambda t: t["name"]).alias("others"),
        frameworks(F.col("low")).alias("frameworks"), F.col("low").rlike(security).alias("security"), F.col("low").rlike(f"{RAG}|{RAG_FRAMEWORKS}").alias("rag"), F.col("low").rlike(f"{GRAPH}|{GRAPH_FRAMEWORKS}").alias("graph"),
    )
    short, unknown, no_language = F.col("words") < 5, F.col("task") == "unknown", F.col("language").isNull()
    part = lambda c, x: F.when(c, x).otherwise(0)
    asked = F.array(F.when(unknown, "task"), F.when(short, "details"), *[F.when(F.col("low").rlike(rf"\b{w}\b"), w) for w in ASKED], F.when(no_language, "language"))
    rows = rows.withColumn("ambiguity", ambiguity(F.col("low"), F.col("words"), unknown, no_language))
    rows = rows.withColumn("questions", F.when(F.col("ambiguity") >= ask_from, F.slice(F.array_compact(asked), 1, 4)).otherwise(F.array().cast("array<string>")))
    weight = F.lit(1)
    for task, score in TASK_SCORE.items():
        weight = F.when(F.col("task") == task, score).otherwise(weight)
    score = weight + part(F.size("others") > 0, 1) + F.least(F.size("frameworks"), F.lit(2)) + part(F.col("n") >= 200, 1) + part(F.col("n") >= 500, 1) + part(F.col("names"), 1)
    level = F.when(score <= 1, 0).when(score == 2, 1).when(score <= 5, 2).otherwise(3)
    level = F.greatest(level, part(F.col("security") | F.col("rag") | F.col("graph") | (F.col("ambiguity") >= ask_from), 2), part(F.col("task") == "planning", 3))
    level = F.greatest(F.least(level + part(F.col("errors") > 0, 1), F.lit(3)), F.lit(CEREMONY.index(least)))
    return rows.select("prompt_id", "task", F.array_join("others", ",").alias("others"), "language", F.array_join("frameworks", ",").alias("frameworks"), "security", "rag", "graph", "ambiguity", F.array_join("questions", ",").alias("questions"), F.element_at(F.array(*map(F.lit, CEREMONY)), level + 1).alias("ceremony"))


#: Concerns of a line, and what makes a review of security or of depth.
CONCERNS = {
    "sql": (r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b|\.(?:execute|query|prepare)\s*\(", "warning"),
    "auth": (r"(?:authenticat\w*|authoriz\w*|login|logout|session|token|permission|role)\b", "warning"),
    "file_io": (r"\bopen\s*\(|(?:read|write|readFile|writeFile|fs\.)", "info"),
    "crypto": (r"(?:encrypt\w*|decrypt\w*|hashlib|hmac|cipher|aes|rsa|sha\d*)\b", "warning"),
    "network": (r"requests\.(?:get|post|put|delete)|fetch\s*\(|axios\.|http\.(?:Get|Post)", "info"),
    "error_handling": (r"try\s*[:{]|except\s|catch\s*\(|\.catch\s*\(", "info"),
    "loops": (r"for\s+\w+\s+in\b|while\s|for\s*\(", "info"),
    "test_quality": (r"assert\s+True\s*$", "info"),
    "concurrency": (r"async\s+def|asyncio\.gather|asyncio\.create_task|threading\.Thread|concurrent\.futures|global\s+\w+\s*$|Lock\(\)|Semaphore\(\)|RLock\(\)", "warning"),
    "boundary": (r"[\w)\]]\s*/\s*[a-zA-Z_]\w*|\[\s*[a-zA-Z_]\w*\s*(?:[+-]\s*\d+\s*)?\]|\bint\s*\(|\bfloat\s*\(|parseFloat\s*\(|parseInt\s*\(|strconv\.(?:Atoi|ParseFloat)", "info"),
    "error_propagation": (r"except\s+\w[\w.]*(?:\s+as\s+\w+)?:\s*$|\.catch\s*\(\s*(?:\(\s*\w*\s*\)\s*=>|function\s*\()\s*\{", "warning"),
    "state_machine": (r"\b(?:status|state|phase|stage|mode)\s*(?:==|===|!=|!==)\s*['\"]|(?:\.status|\.state|\.phase|\.stage)\s*=\s*['\"]", "info"),
}
SECURE, DEEP = ["sql", "auth", "crypto", "violation_deep_dive"], ["concurrency", "error_propagation", "boundary", "state_machine"]
FOLLOW_UPS = ["SEC004", "SEC005", "SEC008", "AI001", "AI003", "TEST001", "TEST002", "TEST003", "TEST005", "DEEP001", "DEEP004"]


def semantic_checks(lines: DataFrame) -> DataFrame:
    """file_id, line, concern, severity: what a reviewer should look at, once a line and concern."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(name).alias("concern"), F.lit(severity).alias("severity"))) for name, (p, severity) in CONCERNS.items()]))
    return lines.withColumn("text", plain(F.col("text"))).select("file_id", "line", F.explode(found).alias("f")).select("file_id", "line", "f.concern", "f.severity")


def follow_ups(violations: DataFrame) -> DataFrame:
    """The same columns for violations with a line that call for a deeper question, the first of a line."""
    asked = violations.where(F.col("rule_id").isin(*FOLLOW_UPS) & F.col("line").isNotNull())
    return asked.groupBy("file_id", "line").agg(F.min_by("severity", "rule_id").alias("severity")).select("file_id", "line", F.lit("violation_deep_dive").alias("concern"), "severity")


def analysis_protocol(checks: DataFrame) -> DataFrame:
    """file_id, kind, areas: how a file with concerns of security or depth should be analysed, and how many places count."""
    held = checks.where(F.col("concern").isin(*SECURE, *DEEP)).groupBy("file_id").agg(F.max(F.col("concern").isin(*SECURE)).alias("s"), F.max(F.col("concern").isin(*DEEP)).alias("d"), F.count("*").alias("areas"))
    return held.select("file_id", F.when(F.col("s") & F.col("d"), "comprehensive_analysis").when(F.col("d"), "deep_analysis").otherwise("security_flow_analysis").alias("kind"), "areas")
