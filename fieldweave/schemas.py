"""Column definitions of the tables that operators pass on."""

PROTO_FILE = "file_ord bigint, file_path string, content string, error string"
DECLARATION = (
    "file_ord bigint, file_path string, syntax string, package string, imports array<string>, kind string, msg_ord int, parents array<string>, message_name string, ord int,"
    " name string, type string, number bigint, label string, comment string, `values` array<struct<name:string,number:bigint>>, rpcs array<struct<name:string,request_type:string,response_type:string>>, error string"
)
FIELD_RECORD = "field_name string, field_type string, message_name string, package string, file_path string, label string, comment string, parent_messages array<string>, ord bigint"
METADATA = "struct<field_name:string,field_type:string,message_name:string,package:string,file_path:string,label:string,fqn:string>"
FIELD_DOC = f"id string, document string, metadata {METADATA}, embedding array<float>"
MAPPINGS = "array<struct<event_type:string,field_name:string,field_type:string,file_path:string>>"
CONCEPT = f"name string, concept_ord bigint, description string, canonical_name string, canonical_type string, mappings {MAPPINGS}, gaps array<string>"
ANSWER = f"array<struct<name:string,description:string,canonical_name:string,canonical_type:string,mappings:{MAPPINGS},gaps:array<string>>>"
ADVICE = "array<struct<title:string,body:string,severity:string,fields:array<string>>>"
