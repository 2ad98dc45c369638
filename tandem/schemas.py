"""Schemas of the conversation-evaluation tables."""

MESSAGE = "struct<from_name: string, from_type: string, message: string>"
METADATA = "struct<language: string, industry: string, problem: string, n_messages: int, n_agents: int, channel: string, agent_experience: string, agent_type: string, model: string>"
GROUPED = f"struct<subject: string, messages: array<{MESSAGE}>, model: string, _metadata: {METADATA}, source_file: string, industry: string, problem: string, channel: string, agent_experience: string, agent_type: string>"
CONVERSATION = f"subject string, messages array<{MESSAGE}>, model string, _metadata {METADATA}"
JUDGE = "conversation_id int, generator_model string, judge_model string, G int, R int, C int, F int, explanation string, source_file string"
LABEL = "conversation_id int, generator_model string, judge_model string, industry string, problem string, channel string, agent_experience string, agent_type string, predicted_industry string, predicted_problem string, explanation string, error string, processing_time double, source_file string"
CATEGORIES = ("industry", "problem", "channel", "agent_experience", "agent_type")
METRICS = {"G": 4, "R": 4, "C": 3, "F": 3}
