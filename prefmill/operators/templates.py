"""Chat templates as rows. A row holds one pattern per role; ``{{content}}`` marks the text, ``{{bos_token}}`` and
``{{eos_token}}`` the tokenizer's own marks."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONTENT = "{{content}}"


@dataclass(frozen=True)
class Template:
    name: str
    user: str = CONTENT
    assistant: str = ""
    system: str = CONTENT
    observation: str = ""
    function: str = ""
    prefix: str = ""
    default_system: str = ""
    call_format: str = "default"
    tool_format: str = "default"
    stop_words: tuple = ()
    thought_open: str = "<think>\n"
    thought_close: str = "\n</think>\n\n"
    call_open: str = "<tool_call>"
    call_close: str = "</tool_call>"
    efficient_eos: bool = False
    replace_eos: bool = False
    kind: str = "plain"  # plain, system_in_user, reasoning, closing (reasoning with only a closing mark when empty)


TEMPLATES: dict[str, Template] = {}


def register_template(name: str, **values) -> Template:
    """Add a template row. Function turns default to the assistant pattern, tool results to the user pattern."""
    if name in TEMPLATES:
        raise ValueError(f"template {name} already exists")
    row = Template(name, **values)
    answer = row.assistant or (CONTENT if row.efficient_eos else CONTENT + "{{eos_token}}")
    row = replace(row, assistant=answer, function=row.function or answer, observation=row.observation or row.user)
    TEMPLATES[name] = row
    return row


# ---- Fixed values: role patterns shared by several templates ---------------------------------------------------------
IM = dict(user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
          assistant="{{content}}<|im_end|>\n", system="<|im_start|>system\n{{content}}<|im_end|>\n",
          stop_words=("<|im_end|>",))
IM_TOOL = dict(IM, observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n")
IM_CALLS = dict(IM, observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n"
                                "<|im_start|>assistant\n", call_format="qwen", tool_format="qwen", replace_eos=True)
IM_LFM = dict(IM, observation="<|im_start|>tool\n<|tool_response_start|>{{content}}<|tool_response_end|><|im_end|>\n"
                              "<|im_start|>assistant\n", call_format="lfm2", tool_format="lfm2", replace_eos=True,
              call_open="<|tool_call_start|>", call_close="<|tool_call_end|>")
IM_SIDES = dict(user="<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>",
                assistant="{{content}}<|im_end|>", system="<|im_system|>system<|im_middle|>{{content}}<|im_end|>",
                stop_words=("<|im_end|>",))
HEADERS = dict(user="<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|>"
                    "<|start_header_id|>assistant<|end_header_id|>\n\n",
               assistant="{{content}}<|eot_id|>",
               system="<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>",
               observation="<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|>"
                           "<|start_header_id|>assistant<|end_header_id|>\n\n",
               call_format="llama3", tool_format="llama3", prefix="{{bos_token}}",
               stop_words=("<|eot_id|>", "<|eom_id|>"), replace_eos=True)
GLM = dict(user="<|user|>\n{{content}}<|assistant|>", assistant="\n{{content}}", system="<|system|>\n{{content}}",
           function="{{content}}", observation="<|observation|>\n{{content}}<|assistant|>", prefix="[gMASK]<sop>",
           stop_words=("<|user|>", "<|observation|>"), efficient_eos=True)
GLM_4 = dict(GLM, call_format="glm4", tool_format="glm4")
GLM_MOE = dict(GLM, call_format="glm4_moe", tool_format="glm4_moe")
TURNS = dict(user="<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n",
             assistant="{{content}}<end_of_turn>\n", system="{{content}}\n\n",
             observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n",
             prefix="{{bos_token}}", stop_words=("<end_of_turn>",), replace_eos=True, kind="system_in_user")
INST_WIDE = dict(user="[INST] {{content}}[/INST]", assistant=" {{content}}{{eos_token}}", system="{{content}}\n\n",
                 function="[TOOL_CALLS] {{content}}{{eos_token}}",
                 observation='[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', call_format="mistral",
                 tool_format="mistral", prefix="{{bos_token}}", kind="system_in_user")
INST = dict(user="[INST]{{content}}[/INST]", system="{{content}}\n\n", function="[TOOL_CALLS]{{content}}{{eos_token}}",
            observation='[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', call_format="mistral",
            tool_format="mistral", prefix="{{bos_token}}", kind="system_in_user")
COLON = dict(user="USER: {{content}} ASSISTANT:", default_system=(
    "A chat between a curious user and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the user's questions."))
PHI = dict(user="<|user|>\n{{content}}<|end|>\n<|assistant|>\n", assistant="{{content}}<|end|>\n",
           system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",), replace_eos=True)
ROLE_TAGS = dict(user="<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n"
                      "<|start_of_role|>assistant<|end_of_role|>", assistant="{{content}}<|end_of_text|>\n",
                 system="<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n")
SEED = dict(user="{{bos_token}}user\n{{content}}{{eos_token}}{{bos_token}}assistant\n",
            system="{{bos_token}}system\n{{content}}{{eos_token}}")
BOS = dict(prefix="{{bos_token}}")
THINK = dict(kind="reasoning")
SHORT_THINK = dict(thought_open="<think>", thought_close="</think>")
HELPFUL = dict(default_system="You are a helpful assistant.")

# ---- Fixed values: the catalogue, by name ---------------------------------------------------------------------------
register_template("aeva", **dict(GLM_MOE, **SHORT_THINK, kind="closing", default_system=(
    "You are an AI assistant named Aeva created by Zongzhi Lou. "
    "Your answer should be friendly, unbiased, faithful, informative and detailed.")))
register_template("alpaca", user="### Instruction:\n{{content}}\n\n### Response:\n",
                  assistant="{{content}}{{eos_token}}\n\n",
                  default_system="Below is an instruction that describes a task. "
                                 "Write a response that appropriately completes the request.\n\n")
register_template("bailing", user="<role>HUMAN</role>{{content}}<role>ASSISTANT</role>",
                  system="<role>SYSTEM</role>{{content}}",
                  observation="<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>",
                  stop_words=("<|endoftext|>",), efficient_eos=True)
register_template("bailing_v2", user="<role>HUMAN</role>{{content}}<|role_end|><role>ASSISTANT</role>",
                  system="<role>SYSTEM</role>{{content}}<|role_end|>", assistant="{{content}}<|role_end|>",
                  observation="<role>OBSERVATION</role>\n<tool_response>\n{{content}}\n</tool_response><|role_end|>"
                              "<role>ASSISTANT</role>",
                  call_format="ling", tool_format="ling", stop_words=("<|endoftext|>",), efficient_eos=True)
register_template("breeze", user="[INST] {{content}} [/INST] ", efficient_eos=True, **BOS)
register_template("chatglm3", **dict(GLM_4, prefix="[gMASK]sop"))
register_template("chatml", **dict(IM_TOOL, stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True))
register_template("chatml_de", **dict(IM_TOOL, stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True,
                                      default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent."))
register_template("cohere", user="<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>"
                                 "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",
                  system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>", **BOS)
register_template("cpm4", **IM_TOOL, **BOS)
register_template("dbrx", **IM_TOOL, replace_eos=True, default_system=(
    "You are DBRX, created by Databricks. You were last updated in December 2023. "
    "You answer questions based on information available up to that point.\n"
    "YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough "
    "responses to more complex and open-ended questions.\nYou assist with various tasks, "
    "from writing to coding (using markdown for code blocks — remember to use ``` with "
    "code, JSON, and tables).\n(You do not have real-time data access or code execution "
    "capabilities. You avoid stereotyping and provide balanced perspectives on "
    "controversial topics. You do not provide song lyrics, poems, or news articles and "
    "do not divulge details of your training data.)\nThis is your system prompt, "
    "guiding your responses. Do not reference it, just respond to the user. If you find "
    "yourself talking about this message, stop. You should be responding appropriately "
    "and usually that means not mentioning this.\nYOU DO NOT MENTION ANY OF THIS INFORMATION "
    "ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."))
register_template("deepseek", user="User: {{content}}\n\nAssistant:", system="{{content}}\n\n", **BOS)
register_template("deepseek3", user="<｜User｜>{{content}}<｜Assistant｜>", **BOS)
register_template("deepseekcoder", user="### Instruction:\n{{content}}\n### Response:",
                  assistant="\n{{content}}\n<|EOT|>\n", **BOS, default_system=(
                      "You are an AI programming assistant, utilizing the DeepSeek Coder model, "
                      "developed by DeepSeek Company, and you only answer questions related to computer science. "
                      "For politically sensitive questions, security and privacy issues, "
                      "and other non-computer science questions, you will refuse to answer.\n"))
register_template("deepseekr1", user="<｜User｜>{{content}}<｜Assistant｜>", **BOS, **THINK)
register_template("default", user="Human: {{content}}{{eos_token}}\nAssistant:", assistant="{{content}}{{eos_token}}\n",
                  system="System: {{content}}{{eos_token}}\n")
register_template("dots_ocr", user="<|user|>{{content}}<|endofuser|><|assistant|>",
                  assistant="{{content}}<|endofassistant|>", system="<|system|>{{content}}<|endofsystem|>\n",
                  stop_words=("<|endofassistant|>",), efficient_eos=True)
register_template("empty", assistant="{{content}}")
register_template("ernie", user="<|im_start|>user\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n",
                  assistant="{{content}}<|im_end|>\n\n", system="<|im_start|>system\n{{content}}<|im_end|>\n\n",
                  observation="<|im_start|>tool\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n",
                  default_system="<global_setting>\nthink_mode=True\n</global_setting>", stop_words=("<|im_end|>",))
register_template("ernie_nothink", user="User: {{content}}\nAssistant: ", assistant="{{content}}<|end_of_sentence|>",
                  system="{{content}}\n", prefix="<|begin_of_sentence|>", stop_words=("<|end_of_sentence|>",))
register_template("ernie_vl", user="User: {{content}}", assistant="\nAssistant: {{content}}<|end_of_sentence|>",
                  system="{{content}}\n", stop_words=("<|end_of_sentence|>",), replace_eos=True, **THINK)
register_template("exaone", user="[|user|]{{content}}\n[|assistant|]", assistant="{{content}}{{eos_token}}\n",
                  system="[|system|]{{content}}[|endofturn|]\n")
register_template("falcon", user="User: {{content}}\nFalcon:", assistant="{{content}}\n", efficient_eos=True)
register_template("falcon_h1", **dict(IM_TOOL, **BOS, stop_words=("<|im_end|>", "<|end_of_text|>")))
register_template("fewshot", assistant="{{content}}\n\n", efficient_eos=True)
register_template("gemma", **TURNS)
register_template("gemma2", **dict(TURNS, stop_words=("<eos>", "<end_of_turn>"), efficient_eos=True, replace_eos=False))
register_template("gemma3", **TURNS)
register_template("gemma3n", **TURNS)
register_template("glm4", **GLM_4)
register_template("glm4_5v", **dict(GLM_MOE, **THINK, stop_words=("<|user|>", "<|observation|>", "</answer>")))
register_template("glm4_7", **dict(GLM_MOE, **SHORT_THINK, kind="closing"))
register_template("glm4_moe", **GLM_MOE, **THINK)
register_template("glm4v", **dict(GLM_4, **THINK, stop_words=("<|user|>", "<|observation|>", "</answer>")))
register_template("glm_ocr", **GLM_4)
register_template("glmz1", **GLM_4, **THINK)
register_template("gpt_oss", user="<|start|>user<|message|>{{content}}<|end|><|start|>assistant",
                  assistant="{{content}}<|end|>", system="<|start|>system<|message|>{{content}}<|end|>",
                  default_system="You are ChatGPT, a large language model trained by OpenAI.",
                  thought_open="<|channel|>analysis<|message|>",
                  thought_close="<|end|><|start|>assistant<|channel|>final<|message|>", efficient_eos=True, **THINK)
register_template("granite3", **ROLE_TAGS)
register_template("granite3_vision", user="<|user|>\n{{content}}\n<|assistant|>\n", system="<|system|>\n{{content}}\n",
                  default_system=COLON["default_system"])
register_template("granite4", **ROLE_TAGS, observation="<|start_of_role|>tool<|end_of_role|>{{content}}<|end_of_text|>\n"
                                                       "<|start_of_role|>assistant\n", stop_words=("<|end_of_text|>",),
                  default_system="You are Granite, developed by IBM. You are a helpful AI assistant.")
register_template("hunyuan", user="{{content}}<|extra_0|>", assistant="{{content}}<|eos|>",
                  system="{{content}}<|extra_4|>", prefix="<|startoftext|>", stop_words=("<|eos|>",))
register_template("hunyuan_small", user="<｜hy_User｜>{{content}}<｜hy_place▁holder▁no▁8｜>",
                  assistant="{{content}}<｜hy_place▁holder▁no▁2｜>", system="{{content}}<｜hy_place▁holder▁no▁3｜>",
                  prefix="<｜hy_begin▁of▁sentence｜>", stop_words=("<｜hy_place▁holder▁no▁2｜>",))
register_template("index", user="reserved_0{{content}}reserved_1", system="<unk>{{content}}", efficient_eos=True)
register_template("intern2", **IM, **BOS, default_system=(
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory "
    "(上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
    "- InternLM (书生·浦语) can understand and communicate fluently in the language "
    "chosen by the user such as English and 中文."))
register_template("intern_s1", **IM, **BOS)
register_template("intern_vl", **IM, **BOS, default_system=(
    "你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。"))
register_template("keye_vl", **IM_CALLS, **THINK)
register_template("kimi_vl", **IM_SIDES, **THINK, default_system="You are a helpful assistant",
                  thought_open="◁think▷", thought_close="◁/think▷")
register_template("lfm2", **IM_LFM, default_system="You are a helpful AI assistant.")
register_template("lfm2_vl", **IM_LFM, default_system="You are a helpful multimodal assistant by Liquid AI.")
register_template("llama2", user="{{bos_token}}[INST] {{content}} [/INST]",
                  system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", kind="system_in_user")
register_template("llama2_zh", user="{{bos_token}}[INST] {{content}} [/INST]",
                  system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", kind="system_in_user",
                  default_system="You are a helpful assistant. 你是一个乐于助人的助手。")
register_template("llama3", **HEADERS)
register_template("llama4", **dict(
    HEADERS, user="<|header_start|>user<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n",
    assistant="{{content}}<|eot|>", system="<|header_start|>system<|header_end|>\n\n{{content}}<|eot|>",
    observation="<|header_start|>ipython<|header_end|>\n\n{{content}}<|eot|>"
                "<|header_start|>assistant<|header_end|>\n\n", stop_words=("<|eot|>", "<|eom|>")))
register_template("llava", **COLON)
register_template("llava_next", **COLON)
register_template("llava_next_llama3", **HEADERS)
register_template("llava_next_mistral", **INST_WIDE)
register_template("llava_next_qwen", **IM_CALLS, **HELPFUL)
register_template("llava_next_video", **COLON)
register_template("llava_next_video_mistral", **INST_WIDE)
register_template("llava_next_video_yi", **IM)
register_template("llava_next_yi", **IM)
register_template("mimo", **IM_CALLS, **HELPFUL, **THINK)
register_template("mimo_v2", **IM_CALLS, **THINK, **SHORT_THINK,
                  default_system="You are MiMo, a helpful AI assistant engineered by Xiaomi.")
register_template("mimo_vl", **IM_CALLS, **THINK, default_system="You are MiMo, an AI assistant developed by Xiaomi.")
register_template("minicpm_o", **IM, default_system=(
    "You are a helpful assistant. You can accept audio and text input and output voice and text."))
register_template("minicpm_v", **IM, **HELPFUL)
register_template("minimax1", user="<beginning_of_sentence>user name=user\n{{content}}<end_of_sentence>\n"
                                   "<beginning_of_sentence>ai name=assistant\n",
                  assistant="{{content}}<end_of_sentence>\n",
                  system="<beginning_of_sentence>system ai_setting=assistant\n{{content}}<end_of_sentence>\n",
                  observation="<beginning_of_sentence>tool name=tools\n{{content}}<end_of_sentence>\n"
                              "<beginning_of_sentence>ai name=assistant\n",
                  call_format="minimax1", tool_format="minimax1", stop_words=("<end_of_sentence>",), **HELPFUL)
register_template("minimax2", user="]~b]user\n{{content}}[e~[\n]~b]ai\n", assistant="{{content}}[e~[\n",
                  system="]~!b[]~b]system\n{{content}}[e~[\n",
                  observation="]~b]tool\n<response>{{content}}</response>[e~[\n]~b]ai\n",
                  call_format="minimax2", tool_format="minimax2", stop_words=("[e~[",), **THINK,
                  default_system="You are a helpful assistant. Your name is MiniMax-M2.1 and is built by MiniMax.")
register_template("ministral", **INST)
register_template("ministral3", **INST)
register_template("mistral", **INST_WIDE)
register_template("mistral_small", **dict(INST, system="[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", kind="plain"))
register_template("mllama", **HEADERS)
register_template("moonlight", **IM_SIDES, replace_eos=True,
                  default_system="You are a helpful assistant provided by Moonshot-AI.")
register_template("olmo", user="<|user|>\n{{content}}<|assistant|>\n", prefix="{{eos_token}}")
register_template("openchat", user="GPT4 Correct User: {{content}}{{eos_token}}GPT4 Correct Assistant:", **BOS)
register_template("openchat-3.6", user="<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|>"
                                       "<|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n",
                  stop_words=("<|eot_id|>",), **BOS)
register_template("opencoder", **IM_TOOL, default_system="You are OpenCoder, created by OpenCoder Team.")
register_template("paligemma", user="{{content}}\n", kind="system_in_user", **BOS)
register_template("paligemma_chat", **dict(TURNS, system="{{content}}"))
register_template("phi", **PHI)
register_template("phi4", user="<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>",
                  assistant="{{content}}<|im_end|>", system="<|im_start|>system<|im_sep|>{{content}}<|im_end|>",
                  stop_words=("<|im_end|>",), replace_eos=True)
register_template("phi4_mini", user="<|user|>{{content}}<|end|><|assistant|>", assistant="{{content}}<|end|>",
                  system="<|system|>{{content}}<|end|>", tool_format="verbatim", stop_words=("<|end|>",),
                  replace_eos=True)
register_template("phi_small", **PHI)
register_template("pixtral", **INST)
register_template("qwen", **IM_CALLS, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.")
register_template("qwen2_audio", **IM, **HELPFUL, replace_eos=True)
register_template("qwen2_omni", **IM_CALLS, **HELPFUL)
register_template("qwen2_vl", **IM_CALLS, **HELPFUL)
register_template("qwen3", **IM_CALLS, **THINK)
register_template("qwen3_5", **dict(IM_CALLS, **THINK, call_format="qwen3_5", tool_format="qwen3_5"))
register_template("qwen3_5_nothink", **dict(IM_CALLS, call_format="qwen3_5", tool_format="qwen3_5"))
register_template("qwen3_nothink", **IM_CALLS)
register_template("qwen3_omni", **IM_CALLS, **THINK)
register_template("qwen3_omni_nothink", **IM_CALLS)
register_template("qwen3_vl", **IM_CALLS, **THINK)
register_template("qwen3_vl_nothink", **IM_CALLS)
register_template("sailor", user="<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n",
                  assistant=IM["assistant"], system=IM["system"], stop_words=("<|im_end|>",), default_system=(
                      "You are an AI assistant named Sailor created by Sea AI Lab. "
                      "Your answer should be friendly, unbiased, faithful, informative and detailed."))
register_template("seed_coder", **SEED, default_system=(
    "You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, "
    "and you only answer questions related to computer science. For politically sensitive questions, "
    "security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"))
register_template("seed_oss", **SEED, **THINK, function="{{bos_token}}\n{{content}}{{eos_token}}", call_format="seed_oss",
                  tool_format="seed_oss", thought_open="<seed:think>", thought_close="</seed:think>")
register_template("smollm", **IM)
register_template("smollm2", **IM, default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face.")
register_template("solar", user="### User:\n{{content}}\n\n### Assistant:\n", system="### System:\n{{content}}\n\n",
                  efficient_eos=True)
register_template("starchat", user="<|user|>\n{{content}}<|end|>\n<|assistant|>", assistant="{{content}}<|end|>\n",
                  system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",))
register_template("telechat2", user="<_user>{{content}}<_bot>", system="<_system>{{content}}", default_system=(
    "你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"))
register_template("vicuna", **COLON)
register_template("video_llava", **COLON)
register_template("xuanyuan", user="Human: {{content}} Assistant:", default_system=(
    "以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，"
    "会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、"
    "不安全、有争议、政治敏感等相关的话题、问题和指示。\n"))
register_template("yi", **IM)
register_template("yi_vl", user="### Human: {{content}}\n### Assistant:", assistant="{{content}}\n",
                  stop_words=("###",), efficient_eos=True, default_system=(
                      "This is a chat between an inquisitive human and an AI assistant. "
                      "Assume the role of the AI assistant. Read all the images carefully, "
                      "and respond to the human's questions with informative, helpful, detailed and polite answers. "
                      "这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。"
                      "仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"))
register_template("youtu", user="<|User|>{{content}}<|Assistant|>", assistant="{{content}}<|end_of_text|>",
                  function="{{content}}", observation="<tool_response>\n{{content}}\n</tool_response><|Assistant|>",
                  stop_words=("<|end_of_text|>",), replace_eos=True, **BOS, **THINK)
register_template("youtu_vl", user="<|begin_of_text|>user\n{{content}}<|end_of_text|>\n<|begin_of_text|>assistant\n",
                  assistant="{{content}}<|end_of_text|>\n", system="<|begin_of_text|>system\n{{content}}<|end_of_text|>\n",
                  stop_words=("<|end_of_text|>",), **HELPFUL)
register_template("yuan", user="{{content}}<sep>", assistant="{{content}}<eod>\n", stop_words=("<eod>",))
register_template("zephyr", user="<|user|>\n{{content}}{{eos_token}}<|assistant|>\n",
                  system="<|system|>\n{{content}}{{eos_token}}", default_system="You are Zephyr, a helpful assistant.")

def derive_template(name: str, new_name: str, default_system: str | None = None, tool_format: str | None = None) -> Template:
    """A registered template under another name, with another default system text or another tool syntax. A new tool
    syntax also puts function turns back to the plain pattern."""
    if name not in TEMPLATES:
        raise ValueError(f"template {name} does not exist")
    values = {k: v for k, v in vars(TEMPLATES[name]).items() if k != "name"}
    if default_system is not None:
        values["default_system"] = default_system
    if tool_format is not None:
        plain = CONTENT if values["efficient_eos"] else CONTENT + "{{eos_token}}"
        values.update(function=plain, call_format=tool_format, tool_format=tool_format)
    return register_template(new_name, **values)


ROLES = ("user", "assistant", "system", "observation", "function")


def pieces(row: Template, bos: str = "<s>", eos: str = "</s>") -> dict:
    """Patterns cut at the text mark, with the tokenizer's marks filled in."""
    if row.replace_eos and row.stop_words:
        eos = row.stop_words[0]
    fill = lambda s: s.replace("{{bos_token}}", bos).replace("{{eos_token}}", eos)
    out = {"prefix": fill(row.prefix), "eos": eos}
    for role in ROLES:
        head, _, tail = fill(getattr(row, role)).partition(CONTENT)
        out[f"{role}_head"], out[f"{role}_tail"] = head, tail
    for name in ("name", "default_system", "call_format", "tool_format", "thought_open", "thought_close", "kind",
                 "call_open", "call_close", "efficient_eos"):
        out[name] = getattr(row, name)
    out["stop_words"] = list(row.stop_words)
    return out


def template(name: str, bos: str = "<s>", eos: str = "</s>") -> dict[str, Column]:
    """A template as literal columns; Catalyst folds what does not depend on the row."""
    if name not in TEMPLATES:
        raise ValueError(f"template {name} does not exist")
    return {k: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
            for k, v in pieces(TEMPLATES[name], bos, eos).items()}


def template_table(spark: SparkSession, names: list[str] | None = None, bos: str = "<s>", eos: str = "</s>") -> DataFrame:
    """The catalogue as a dimension table (one row per template, so small enough to broadcast)."""
    rows = [pieces(TEMPLATES[n], bos, eos) for n in (names or sorted(TEMPLATES))]
    fields = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}"
                       for k, v in rows[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], fields)


def stop_words(tpl: dict[str, Column]) -> Column:
    """The end mark and the template's stop words, each once, sorted."""
    return F.array_sort(F.array_union(F.array(tpl["eos"]), tpl["stop_words"]))
