"""Modules of this folder that have QUERIES and SQL."""

from spanforge.llm import q_containers, q_conversations, q_mixture, q_subjects, q_token_ids

MODULES = [q_conversations, q_containers, q_token_ids, q_mixture, q_subjects]
