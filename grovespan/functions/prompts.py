"""The judge's prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dated evaluator's prompt templates by task, then for unanswerable questions, and the two answer formats.
TEMPLATES = {
    "single-session-user": "I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response is equivalent to the correct answer or contains all the intermediate steps to get the correct answer, you should also answer yes. If the response only contains a subset of the information required by the answer, answer no. \n\nQuestion: {}\n\nCorrect Answer: {}\n\nModel Response: {}\n\nIs the model response correct? Answer yes or no only.",
    "temporal-reasoning": "I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response is equivalent to the correct answer or contains all the intermediate steps to get the correct answer, you should also answer yes. If the response only contains a subset of the information required by the answer, answer no. In addition, do not penalize off-by-one errors for the number of days. If the question asks for the number of days/weeks/months, etc., and the model makes off-by-one errors (e.g., predicting 19 days when the answer is 18), the model's response is still correct. \n\nQuestion: {}\n\nCorrect Answer: {}\n\nModel Response: {}\n\nIs the model response correct? Answer yes or no only.",
    "knowledge-update": "I will give you a question, a correct answer, and a response from a model. Please answer yes if the response contains the correct answer. Otherwise, answer no. If the response contains some previous information along with an updated answer, the response should be considered as correct as long as the updated answer is the required answer.\n\nQuestion: {}\n\nCorrect Answer: {}\n\nModel Response: {}\n\nIs the model response correct? Answer yes or no only.",
    "single-session-preference": "I will give you a question, a rubric for desired personalized response, and a response from a model. Please answer yes if the response satisfies the desired response. Otherwise, answer no. The model does not need to reflect all the points in the rubric. The response is correct as long as it recalls and utilizes the user's personal information correctly.\n\nQuestion: {}\n\nRubric: {}\n\nModel Response: {}\n\nIs the model response correct? Answer yes or no only.",
}
UNANSWERABLE = "I will give you an unanswerable question, an explanation, and a response from a model. Please answer yes if the model correctly identifies the question as unanswerable. The model could say that the information is incomplete, or some other information is given but the asked information is not.\n\nQuestion: {}\n\nExplanation: {}\n\nModel Response: {}\n\nDoes the model correctly identify the question as unanswerable? Answer yes or no only."
SAME_AS_USER = ("single-session-assistant", "multi-session")
YES_NO = "Answer yes or no only."
JSON_ONLY = 'Return exactly one JSON object and no other text: {"label":1} for yes or {"label":0} for no.'


def judge_prompt(task: Column, question: Column, answer: Column, response: Column, abstention: Column, json_only: bool = False) -> Column:
    """The prompt of a task; an unknown task is an error unless the question is unanswerable."""

    def filled(template: str) -> Column:
        pieces = [p.replace(YES_NO, JSON_ONLY) if json_only else p for p in template.split("{}")]
        return F.concat(F.lit(pieces[0]), question, F.lit(pieces[1]), answer, F.lit(pieces[2]), response, F.lit(pieces[3]))

    out = F.when(abstention, filled(UNANSWERABLE)).when(task.isin(*SAME_AS_USER), filled(TEMPLATES["single-session-user"]))
    for name, template in TEMPLATES.items():
        out = out.when(task == name, filled(template))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown task "), task)).cast("string"))
