"""The closed set of entity and relation types, and the prompt that asks for them."""

from __future__ import annotations

#: Fixed values.
ENTITY_TYPES = (
    "Person", "Organization", "Team", "Role", "Location", "Concept", "Technology", "SoftwareApplication", "SoftwareModule", "Feature", "UserInterface",
    "ApiEndpoint", "DataEntity", "Database", "Configuration", "Permission", "Workflow", "Task", "Event", "Error", "Policy", "Product",
)
#: Fixed values.
RELATION_TYPES = (
    "RELATED_TO", "PART_OF", "DEPENDS_ON", "USES", "INTEGRATES_WITH", "EXPOSES", "CALLS", "READS_FROM", "WRITES_TO", "CONFIGURES", "REQUIRES", "GRANTS",
    "PERMITS", "DENIES", "TRIGGERS", "PRECEDES", "PRODUCES", "RESOLVES", "AFFECTS", "IMPLEMENTS", "MANAGES", "ASSIGNED_TO", "WORKS_AT",
)


def prompt(text: str) -> str:
    """What asks a model for the entities and relations of a chunk."""
    return (
        "Return one JSON object with the lists entities (id, type, name, description) and relations (source_id, target_id, type, description, confidence).\n"
        f"Entity types: {', '.join(ENTITY_TYPES)}.\nRelation types: {', '.join(RELATION_TYPES)}.\nUse no other types, and only what the text says.\n\nText:\n{text}"
    )
