"""Scan targets: which tools keep their sessions where, what to leave out, and who owns a path."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K

SCHEMA = "tool string, root string, exclude_dirs array<string>, exclude_files array<string>, exclude_suffixes array<string>, ordinal int, candidate int"


def excluded_by_dir(path: Column, dirs: Column, root: Column | None = None) -> Column:
    """A folder or the name itself, below ``root`` if given, is in ``dirs``."""
    below = path if root is None else F.substr(path, F.length(root) + 1)
    return F.arrays_overlap(F.split(below, "/"), dirs)


def excluded_by_name(path: Column, files: Column, suffixes: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.array_contains(files, name) | F.exists(suffixes, lambda s: F.endswith(name, s))


def excluded(path: Column, root: Column, dirs: Column, files: Column, suffixes: Column, home: str) -> Column:
    """Left out by a folder, or by name unless it is a managed file, which is looked at all the same."""
    return excluded_by_dir(path, dirs, root) | (excluded_by_name(path, files, suffixes) & ~is_managed(path, home))


def is_under(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_managed(path: Column, home: str) -> Column:
    """Credential files: under the home folder, by the tail of their path, or by name."""
    inside = F.when(F.startswith(path, F.lit(home + "/")), F.substr(path, F.lit(len(home) + 2)))
    tails = F.array(*map(F.lit, K.MANAGED_TAILS))
    return F.coalesce(
        F.coalesce(inside.isin(K.MANAGED_FILES), F.lit(False))
        | F.coalesce(F.startswith(inside, F.lit(K.MANAGED_FOLDER + "/")), F.lit(False))
        | F.exists(tails, lambda t: F.endswith(path, F.concat(F.lit("/"), t)) | (path == t))
        | (F.element_at(F.split(path, "/"), -1) == K.MANAGED_NAME),
        F.lit(False),
    )


def discover(candidates: DataFrame) -> DataFrame:
    """Targets: of each tool the first candidate root that exists, all of one pattern's; each root once, by the order of tools."""
    first = candidates.where("exists").withColumn("r", F.rank().over(Window.partitionBy("tool").orderBy("candidate"))).where("r = 1").drop("r", "exists")
    once = first.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("ordinal", "candidate"))).where("r = 1")
    return once.drop("r")


def candidates_here(spark: SparkSession, registry: list[tuple[str, list[str], list[str], list[str], list[str]]]) -> DataFrame:
    """Rows for (tool, roots, dirs, files, suffixes); roots may hold ``~`` and ``*``. Lists this machine's folders."""
    rows = []
    for ordinal, (tool, roots, dirs, files, suffixes) in enumerate(registry):
        for i, root in enumerate(roots):
            full = os.path.expanduser(root)
            for path in sorted(glob.glob(full)) or [full]:
                rows.append((tool, path, dirs, files, suffixes, ordinal, i, os.path.isdir(path)))
    return spark.createDataFrame(rows, SCHEMA + ", exists boolean")


def only(targets: DataFrame, wanted: list[str]) -> DataFrame:
    """The tools asked for, by lower-case names separated by commas too; ``custom`` always stays."""
    names = {x.strip().lower() for w in wanted for x in w.split(",") if x.strip()}
    known = {r["tool"] for r in targets.select("tool").distinct().collect()} | {"custom"}  # as many as tools
    if names - known:
        raise ValueError(f"unknown tools: {sorted(names - known)}")
    return targets.where(F.col("tool").isin([*names, "custom"]) if names else F.lit(True))


#: Files in the home folder itself that belong to a tool.
HOME_FILES = {".claude.json": "claude", ".aider.conf.yml": "aider"}


def associated(paths: DataFrame, chosen: DataFrame, home: str) -> DataFrame:
    """The managed files of the chosen tools: below one of their roots, or theirs in the home folder."""
    own = chosen.select("tool", "root")
    files = [(f"{home}/{name}", tool) for name, tool in HOME_FILES.items()]
    homes = paths.sparkSession.createDataFrame(files, "path string, tool string").join(own.select("tool").distinct(), "tool", "left_semi")
    held = paths.join(F.broadcast(own), is_under(F.col("path"), F.col("root")), "left_semi")  # a fixed registry
    return held.union(paths.join(F.broadcast(homes), "path", "left_semi").select(*paths.columns)).distinct()


def owners(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """``paths`` with the tool, root and relative path of the first target that holds each; null where none does."""
    held = paths.join(F.broadcast(targets.select("tool", "root", "ordinal")), is_under(F.col("path"), F.col("root")), "left")  # a fixed registry
    best = held.groupBy(*paths.columns).agg(F.min_by(F.struct("tool", "root"), "ordinal").alias("o"))
    return best.select(*paths.columns, "o.tool", "o.root", F.when(F.col("o").isNotNull(), F.substr("path", F.length("o.root") + 2)).alias("relative"))


def custom(paths: list[str], ordinal: int) -> list[tuple]:
    """Rows of SCHEMA for folders given by hand, which come after the registry's and leave nothing out."""
    return [("custom", p.rstrip("/") or "/", [], [], [], ordinal + i, 0) for i, p in enumerate(paths)]


def labels(paths: DataFrame, targets: DataFrame, home: str) -> DataFrame:
    """``paths`` with the ``source`` that reports name and the path below it: a target's tool, else managed credentials, else ``?``."""
    owned = owners(paths, targets)
    inside = F.startswith("path", F.lit(home + "/"))
    other = F.when(inside, "Managed credentials").otherwise("?")
    below = F.when(inside, F.substr("path", F.lit(len(home) + 2))).otherwise(F.col("path"))
    return owned.select(*paths.columns, F.coalesce("tool", other).alias("source"), F.when(F.col("tool").isNotNull(), F.col("relative")).otherwise(below).alias("relative"))


#: The tools, their candidate folders, and what is left out of each: (tool, roots, dirs, files, suffixes).
REGISTRY = [
    ("claude", ["~/.claude"], ["backups", "cache", "image-cache", "marketplaces", "statsig", "telemetry"], [".credentials.json", "settings.json"], []),
    ("codex", ["~/.codex"], [".git", ".tmp", "cache", "generated_images", "plugins", "skills", "tmp"], ["auth.json", ".credentials.json", "models_cache.json"], []),
    ("cursor", ["~/.cursor"], ["bin", "extensions", "node_modules", "plugins", "CachedProfilesData", "CachedExtensionVSIXs"], ["mcp.json"], []),
    (
        "cursor-server",
        ["~/.cursor-server"],
        ["bin", "extensions", "node_modules", "cli", "CachedProfilesData", "CachedExtensionVSIXs", "History", "Machine", "logs"],
        ["languagepacks.json", "machineid", "mcp.json", "settings.json"],
        [".log", ".pid", ".token"],
    ),
    (
        "cursor-app",
        [
            "~/Library/Application Support/Cursor/User/workspaceStorage",
            "~/.config/Cursor/User/workspaceStorage",
            "~/AppData/Roaming/Cursor/User/workspaceStorage",
        ],
        ["bin", "extensions", "node_modules", "CachedProfilesData", "CachedExtensionVSIXs"],
        ["mcp.json"],
        [],
    ),
    ("antigravity", ["~/.antigravity-server"], ["bin", "extensions", "node_modules", "CachedProfilesData", "CachedExtensionVSIXs", "logs"], ["mcp.json", "mcp_config.json"], []),
    ("aider", ["~/.aider"], [], [], []),
    ("continue", ["~/.continue"], [], ["config.yaml", "config.json", "config.ts", ".env"], []),
    (
        "windsurf",
        ["~/.codeium/windsurf", "~/.config/Codeium/Windsurf", "~/AppData/Roaming/Codeium/Windsurf", "~/.windsurf"],
        ["extensions"],
        ["mcp.json", "mcp_config.json"],
        [],
    ),
    ("windsurf-server", ["~/.windsurf-server"], ["bin", "extensions", "node_modules", "CachedProfilesData", "CachedExtensionVSIXs", "logs"], ["mcp.json", "mcp_config.json"], []),
    (
        "windsurf-app",
        [
            "~/Library/Application Support/Windsurf/User/workspaceStorage",
            "~/.config/Windsurf/User/workspaceStorage",
            "~/AppData/Roaming/Windsurf/User/workspaceStorage",
        ],
        ["bin", "extensions", "node_modules", "CachedProfilesData", "CachedExtensionVSIXs"],
        ["mcp.json", "mcp_config.json"],
        [],
    ),
    (
        "zed",
        ["~/.local/share/zed", "~/Library/Application Support/Zed", "~/AppData/Roaming/Zed", "~/.config/zed/conversations"],
        [],
        ["settings.json", "keymap.json", "tasks.json"],
        [],
    ),
    (
        "gemini",
        ["~/.gemini"],
        ["antigravity-browser-profile"],
        [
            "oauth_creds.json", "mcp-oauth-tokens.json", "mcp_config.json", "settings.json", "google_accounts.json", "trustedFolders.json",
            "installation_id", "user_id",
        ],
        [],
    ),
    ("opencode", ["~/.local/share/opencode"], [], ["auth.json", "mcp-auth.json"], []),
    ("opencode-config", ["~/.config/opencode"], [], ["opencode.json", "opencode.jsonc", "tui.json", "tui.jsonc"], []),
    ("crush", ["~/.local/share/crush"], [], ["mcp.json", "crush.json"], []),
    ("crush-config", ["~/.config/crush"], [], ["crush.json"], []),
    (
        "cline",
        [
            "~/Library/Application Support/Code/User/globalStorage/saoudrizwan.claude-dev",
            "~/.config/Code/User/globalStorage/saoudrizwan.claude-dev",
            "~/AppData/Roaming/Code/User/globalStorage/saoudrizwan.claude-dev",
            "~/.cline/data",
        ],
        [],
        ["cline_mcp_settings.json", "secrets.json"],
        [],
    ),
    (
        "copilot-chat",
        [
            "~/Library/Application Support/Code/User/workspaceStorage/*/GitHub.copilot-chat",
            "~/Library/Application Support/Code/User/workspaceStorage/*/github.copilot-chat",
            "~/.config/Code/User/workspaceStorage/*/GitHub.copilot-chat",
            "~/.config/Code/User/workspaceStorage/*/github.copilot-chat",
            "~/AppData/Roaming/Code/User/workspaceStorage/*/GitHub.copilot-chat",
            "~/AppData/Roaming/Code/User/workspaceStorage/*/github.copilot-chat",
        ],
        [],
        [],
        [],
    ),
]
