"""Logical relations of a knowledge base as Spark schemas (DDL)."""

DOCUMENTS = (
    "id long, path string, title string, doc_date date, doc_type string, source_system string, source_id string, tags array<string>, "
    "content_hash string, chunk_count int, indexed_at timestamp, abstract string, overview string, pinned boolean"
)
CHUNKS = "chunk_id long, document_id long, chunk_index int, heading string, content string, metadata_prefix string"
ENTITIES = (
    "id long, name string, entity_type string, aliases array<string>, metadata map<string,string>, source_path string, pinned boolean, "
    "updated_at timestamp, last_mentioned_at date, attributes variant"
)
MENTIONS = "entity_id long, document_id long, mention_type string"
FACTS = "id long, entity_id long, fact_text string, fact_date date, created_at timestamp, seq int"
ATTENDEES = "document_id long, entity_id long, name string, email string, matched_by string"
GLOSSARY = "term string, expansion string, section string"
TEXTS = (
    "id long, path string, title string, doc_date date, doc_type string, source_system string, source_id string, tags array<string>, content_hash string, "
    "pinned boolean, text string, attendees array<struct<name:string,email:string,company:string>>"
)
REMOVED = "id long, path string, doc_type string, pinned boolean"
POSTINGS = "term string, chunk_id long, col string, tf int, positions array<int>, document_id long, dl long, block int"
IMPACTS = "kind string, term string, block int, n long, most double, least long"
VECTORS = "chunk_id long, document_id long, embedding array<float>, hash string"
LENGTHS = "chunk_id long, document_id long, dl long"
PROFILES = "id long, name string, entity_type string, profile string, embedding array<float>"
ACCESS = "kind string, id long, at timestamp"
SUPPRESSIONS = "path string, entity string"

TABLES = {
    "documents": DOCUMENTS, "chunks": CHUNKS, "entities": ENTITIES, "mentions": MENTIONS, "facts": FACTS, "attendees": ATTENDEES,
    "glossary": GLOSSARY, "access": ACCESS, "suppressions": SUPPRESSIONS, "profiles": PROFILES,
    "texts": TEXTS, "removed": REMOVED, "impacts": IMPACTS, "postings": POSTINGS, "stemmed": POSTINGS, "lengths": LENGTHS, "vectors": VECTORS,
}

#: The column that says whose rows a batch replaces.
KEYS = {"documents": "id", "texts": "id"} | dict.fromkeys(("chunks", "postings", "stemmed", "lengths", "vectors", "mentions", "attendees"), "document_id")
#: Tables that are stored in an order, so that a look-up reads few row groups.
ORDER = dict.fromkeys(("postings", "stemmed"), ("term", "block", "chunk_id"))
