"""Settings and fixed values."""

from __future__ import annotations

from dataclasses import dataclass

# They must be these for equal results.
MAX_FILE_SIZE = 5 * 1024 * 1024
EXCLUDED_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bin", ".zip", ".tar", ".gz", ".svg", ".idx", ".rev", ".pack", ".DS_Store", ".pdf", ".pptx")
SOURCE_TAG = "repo_file:"
MODEL_TYPE = "Instruct"
CODE_HOST = "github.com"
DEFAULT_SYSTEM = "You are a helpful AI assistant."
TRUNCATE_OVER, TRUNCATE_KEEP, TRUNCATE_MARK = 2048, 1024, "\n... [Content truncated for model context window] ...\n"
TEMPLATES = ("csv", "llama3", "mistral", "gemma", "alpaca-jsonl", "chatml-jsonl")
NO_QUESTIONS, NO_ANSWER, READ_TIMEOUT = "LLM failed to generate questions", "LLM failed to generate answer", "Timeout reading file"


@dataclass
class Settings:
    """What a run can be told; every flag of the command line lands here.

    ``files_in_flight`` calls are made at a time in each of ``model_tasks`` tasks (0: one for each core).
    """

    base_url: str = "http://localhost:8000"
    model: str = ""
    backend: str = "stub"
    retries: int = 3
    retry_delay: float = 5.0
    model_list_ttl: float = 300.0
    request_timeout: float = 300.0
    max_tokens: int = 500
    temperature: float = 0.7
    data_dir: str = "data"
    repos_dir: str = "repos"
    max_file_size: int = MAX_FILE_SIZE
    files_in_flight: int = 1
    model_tasks: int = 0
    read_timeout: float = 300.0
    by_repo: bool = False
    max_log_files: int = 5
    mark_seen: bool = False
    #: Files of a repository that ``by_repo`` works on and commits at a time (0: all of them).
    batch_files: int = 0
    #: Days for which results of model calls are used again by later runs (0: not at all).
    memo_days: float = 7.0
    #: What loads the model of the "local" backend (``package.module:function``), and prompts in a batch.
    local_model: str = ""
    local_batch: int = 8
    #: Lanes of requests and clones to one host; together they keep the pause between two requests.
    lanes_per_host: int = 4
