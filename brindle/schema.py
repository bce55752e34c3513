"""Table schemas of the document store, and value checks of requests."""

from __future__ import annotations

CHUNKS = (
    "id long, user_id string, document_id string, filename string, file_type string, file_size int, chunk_index int, unit string, collection string, "
    "content string, source string, content_hash string, embedding array<float>, doc_metadata string, is_encrypted boolean, created_at timestamp, "
    "updated_at timestamp, deleted_at timestamp"
)
QUERY_LOGS = "id long, query_text string, answer_preview string, response_time_ms int, chunks_retrieved int, top_source string, user_ip string, created_at timestamp"
AUDIT_LOGS = (
    "id long, user_id string, user_ip string, request_id string, query_text string, answer_text string, system_prompt string, temperature double, top_k int, "
    "used_documents array<struct<filename:string,chunk_index:int,similarity:double>>, chunks_retrieved int, response_time_ms int, model string, token_count int, "
    "status string, error string, pii_found boolean, pii_types array<string>, classification string, unit string, collection string, endpoint string, "
    "user_agent string, created_at timestamp"
)
API_KEYS = "id long, key_hash string, name string, owner string, allowed_operations array<string>, allowed_endpoints array<string>, is_active boolean, expires_at timestamp, last_used_at timestamp, created_at timestamp"
DOCUMENT_CHUNKS = "id long, document_id string, chunk_index int, content string, token_count int, doc_metadata string, created_at timestamp"
EMBEDDINGS = "id long, chunk_id long, embedding array<float>, model string, created_at timestamp"
TABLES = {"chunks": CHUNKS, "query_logs": QUERY_LOGS, "audit_logs": AUDIT_LOGS, "api_keys": API_KEYS, "document_chunks": DOCUMENT_CHUNKS, "embeddings": EMBEDDINGS}


def check_question(query: str, top_k: int = 10, temperature: float = 0.0) -> None:
    if not 1 <= len(query or "") <= 5000:
        raise ValueError("a question has 1 to 5000 characters")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    if not 0 <= temperature <= 1:
        raise ValueError("temperature is 0 to 1")


def check_scope(filenames: list[str] | None, unit: str | None, collection: str | None) -> None:
    """A scoped question names at least one of its scopes."""
    if not (filenames or unit or collection):
        raise ValueError("one of filenames, unit or collection is needed")


def scope_filenames(filenames: list[str] | None = None, filename: str | None = None) -> list[str] | None:
    """The trimmed names that are not blank; the single name counts where the list has none."""
    named = [x.strip() for x in filenames or [] if x and x.strip()]
    return named or ([filename.strip()] if filename and filename.strip() else None)
