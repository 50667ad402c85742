"""Declared schemas. Receipts are never inferred: always-null fields would get wrong types."""

from vigilake.operators.classify import TOUCHED
from vigilake.operators.evaluate import DECISION

# Field order inside every struct is alphabetical, so that to_json() of a built
# receipt is already in canonical key order.
ACTOR = "struct<auth_method:string,department:string,user_id:string,user_role:string>"
TOOL = "struct<endpoint:string,model_id:string,model_vendor:string,tool_id:string,tool_version:string>"
REFERENCE = "struct<access_method:string,fields_accessed:array<string>,resource_id:string,type:string>"
ACTION = (
    "struct<action_id:string,content_hash:string,diff_from_response:boolean,target_path:string,"
    "target_size_bytes:bigint,timestamp:string,type:string>"
)
PROMPT = f"struct<context_references:array<{REFERENCE}>,text:string,text_hash:string,text_length_chars:bigint>"
RESPONSE = "struct<latency_ms:bigint,text:string,text_hash:string,text_length_chars:bigint,tokens_used:bigint>"
EVIDENCE = "struct<capture_method:string,captured_by:string,receipt_hash:string,signature:string>"
RETENTION = "struct<deletable_after:string,legal_hold:boolean,retain_until:string,retention_policy:string>"
SORTED_TOUCHED = "struct<class:string,in_prompt:boolean,in_response:boolean,instances:bigint>"
SORTED_DECISION = (
    "struct<alert_id:struct<delivered_at:string,delivery_status:string,id:string>,enforcement_mode:string,"
    "error_reason:string,evaluated_at:string,matched_classes:array<string>,policy_id:string,"
    "policy_set_version:string,policy_version:string,"
    "redactions_applied:array<struct<after_hash:string,before_hash:string,location:string>>,"
    "verdict:string,would_have_blocked:boolean>"
)
RECEIPT = (
    f"struct<actor:{ACTOR},data_classes_touched:array<{SORTED_TOUCHED}>,downstream_actions:array<{ACTION}>,"
    f"evidence:{EVIDENCE},external_trace_uri:string,policy_decisions:array<{SORTED_DECISION}>,prompt:{PROMPT},"
    f"receipt_id:string,response:{RESPONSE},retention:{RETENTION},schema_version:string,timestamp:string,tool:{TOOL}>"
)

NODE = (
    "file string, line_no bigint, timestamp string, node_id string, parent_id string, type string, name string, "
    "inputs string, outputs string, provenance string, audit_flags array<string>"
)
TRAP = "project string, id string, `on` string, action string, `limit` int, threshold double, status string"
RUN = (
    "struct<run_id:string,parent_run_id:string,run_type:string,name:string,inputs:string,outputs:string,"
    "error:string,start_time:string,end_time:string>"
)

__all__ = [name for name in dir() if name.isupper()]
