"""Declared schemas of the chat entities. Nothing is inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _L, _T = StringType(), LongType(), TimestampType()
TOOL_CALL = _struct(id=_S, type=_S, function=_struct(name=_S, arguments=_S))
CHAT_MESSAGE = _struct(
    id=_S, session_id=_S, role=_S, content=_S, search_tokens=_S, token_count=_L, metadata=MapType(_S, _S),
    tool_calls=ArrayType(TOOL_CALL), tool_call_id=_S, name=_S, created_at=_T,
)
CHAT_SESSION = _struct(
    id=_S, user_id=_S, title=_S, is_pinned=BooleanType(), pinned_at=_T, created_at=_T, updated_at=_T, current_summary=_S, summary_updated_at=_T
)
MODEL_CONFIG = _struct(id=_S, providers=ArrayType(_struct(provider_id=IntegerType(), model_id=_S)), is_active=BooleanType())
MEMORY_ITEM = _struct(id=_S, user_id=_S, memory=_S, metadata=MapType(_S, _S), embedding=ArrayType(FloatType()), score=DoubleType())
USAGE_EVENT = _struct(userId=_S, groupId=_S, usageTokens=_L, traceId=_S, modelType=IntegerType(), requestTime=_S)
LLM_DELTA = _struct(call=_S, seq=_L, index=IntegerType(), id=_S, name=_S, arguments=_S, content=_S, finish_reason=_S)
CHAT_REQUEST = _struct(query=_S, session_id=_S, model=_S, selected_text=_S)

#: The roles of a message.
ROLES = ("system", "user", "assistant", "tool")
DEFAULT_TITLE = "New Chat"
