"""What users of the SQL entry point are told."""

SECTIONS = {
    "workflows": "# Workflows\n\nSearch by meaning: find the vectors nearest to a statement with MATCH, join them with `documents`, rerank the few that are left.\nSupport a claim: split it into statements, search for each, read the chunks that come back; pages are in `metadata_json` under `$.loc`.\nCheck a passage: look in `documents` of kind `fulltext_chunk`, `note` and `annotation` with ILIKE or RLIKE.",
    "schema": "# Tables\n\n`references`, `reference_external_ids`, `document_files`, `documents`, `vectors`, and for the work to be done `jobs`, `job_attempts`, `worker_runs`. JSON columns are read with `json_extract(column, path)`.",
    "examples": "# Examples\n\nSELECT d.kind, d.content, n.distance FROM (SELECT * FROM vectors WHERE embedding MATCH embed('a topic') AND k = 30) n JOIN documents d ON d.id = n.doc_id ORDER BY rerank_score('a topic', d.content) DESC LIMIT 10",
}


def text(section: str | None = None) -> str:
    return SECTIONS.get(section or "", "Sections: " + ", ".join(SECTIONS) + ".")
